"""kgloom: knowledge-graph construction, entity resolution, vocabulary linking and retrieval as Spark plans."""

__all__ = ["catalog", "scratch", "session"]
