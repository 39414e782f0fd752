"""Spark-native knowledge retrieval: corpora, lexical and vector ranking, routing and live transcripts."""
