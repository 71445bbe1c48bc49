"""Registered queries of the corpus operators and, where SQL can express one, the same in DuckDB SQL."""

from .ann import op5_ann
from .clusters import OP13_SQL, op13_clusters
from .divergence import OP12_SQL, op12_divergence
from .extraction import op2_extraction
from .langid import op1_langid
from .lines import OP8_SQL, op8_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .sentencepieces import op7_sentencepiece
from .shards import OP11_SQL, op11_sharding
from .simhash import op10_simhash
from .suffixes import op6_suffixes
from .topk import OP4_SQL, op4_topk
from .toxicity import op3_toxicity

QUERIES = {
    "op1_langid": op1_langid,
    "op2_extraction": op2_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_ann": op5_ann,
    "op6_suffixes": op6_suffixes,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_sharding": op11_sharding,
    "op12_divergence": op12_divergence,
    "op13_clusters": op13_clusters,
}

ORACLES = {
    "op4_topk": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op11_sharding": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_clusters": OP13_SQL,
}
