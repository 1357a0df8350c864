"""The production queries of this folder and their SQL."""

from __future__ import annotations

from . import digests
from .jaccard import JACCARD_SQL, jaccard_query
from .langid import langid_query
from .mixing import MIX_SQL, mix_query
from .neighbours import neighbours_query
from .packing import packing_query
from .pii import pii_query
from .quality import quality_query
from .sharding import shard_query
from .tokens import tokens_query
from .urls import urls_query

QUERIES = {
    "op1_token_counts": tokens_query,
    "op2_external_shuffle": shard_query,
    "op3_url_filter": urls_query,
    "op4_pii": pii_query,
    "op5_best_fit_packing": packing_query,
    "op6_permutation_index": neighbours_query,
    "op7_quality_rules": quality_query,
    "op8_mixing": mix_query,
    "op9_jaccard_join": jaccard_query,
    "op10_language_id": langid_query,
    **digests.QUERIES,
}

ORACLE_SQL = {"op8_mixing": MIX_SQL, "op9_jaccard_join": JACCARD_SQL, **digests.SQL}
