"""Collects the registered queries of this folder."""

from placescore.llm import alignment, bpe, exact_dedup, hard_negatives, jaccard, language, packing, pii, shortest_first, substrings, topk, url_filters, warc  # noqa: F401
from placescore.llm.common import ORACLES, QUERIES  # noqa: F401
