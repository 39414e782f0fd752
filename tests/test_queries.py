"""Registered queries against their SQL at the smallest scale (all of them: `python tests/oracle.py 0.01`)."""

import os

import pytest

import __spark_entry__ as entry_module
from tests import oracle

SF_DIR = f"{oracle.DATA}/sf0.001"
NAMES = (
    "valid_documents",
    "latest_documents",
    "parse_sections",
    "chunk_documents",
    "section_retrieval_text",
    "lexical_top_k",
    "fuse_candidates",
    "vector_top_k",
    "normalise_terms",
    "answer_scope",
    "eligible_sections",
    "route_answers",
    "silence_sessions",
    "frame_gaps",
    "resample_signal",
    "gate_events",
    "assemble_answers",
    "answer_materials",
    "answer_materials_by_method",
    "archived_without_twin",
    "capture_outcomes",
    "collapse_repeats",
    "cosine_similarity",
    "diagram_text",
    "display_form",
    "embed_sections",
    "markup_pipe_tables",
    "markup_tables",
    "throttled_rebuilds",
    "voice_sessions",
    "fold_captures",
    "fold_transcripts",
    "timed_captures",
    "missed_frames",
    "normalise_questions",
    "prompt_texts",
    "route_title_questions",
    "title_evidence",
    "explicit_title_questions",
    "answer_job",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    result = oracle.compare(spark, oracle.duck(SF_DIR), SF_DIR, name, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert result["ok"] and result["rows"] > 0, result


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).columns == ["query_id", "rank", "doc_ord", "chunk_index", "score"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
