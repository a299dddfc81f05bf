"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from reelbase.llm import languages, mojibake, packing, pieces, reading, runs, scans, survivors, tokens

_MODULES = (mojibake, pieces, scans, languages, runs, survivors, tokens, packing, reading)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE", {}).items()}
