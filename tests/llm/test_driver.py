"""The driver's heap between the stages of the pipeline."""

import pytest

import corpus_pipeline


def test_stages_begin_with_a_cleared_heap(spark, monkeypatch):
    cleared = []
    monkeypatch.setattr(corpus_pipeline, "release_heap", cleared.append)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(AttributeError):
            stage(spark, None, "")
    assert cleared == [spark] * len(corpus_pipeline.STAGES)


def test_the_driver_gives_freed_memory_back(spark):
    """Not only the heap: what compilers and threads have freed outside it goes back to the system, and the stages of the pipeline ask for that."""
    from curvelark.operators.staging import release_heap

    assert "trim native heap" in (release_heap(spark) or "").lower()
