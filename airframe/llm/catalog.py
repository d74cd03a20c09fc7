"""All queries of this folder. Importing this module fills the registry."""

import corpus_pipeline
from airframe.llm import chat, decontaminate, langid, licences, mixing, quality, sharding, simhash, suffix, trie, urls, vectors, whitening  # noqa: F401
from airframe.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
