"""All queries of this subpackage and their SQL twins."""

from postmill.llm import (  # noqa: F401
    bm25, bpe, decon, linedup, mainhtml, neardup, packing, ring, toxic, urltree, variants, warc, whiten)
from postmill.llm.registry import ORACLES, QUERIES  # noqa: F401
