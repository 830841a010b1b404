"""Corpus operators do the whole job: cases that an earlier, cut form missed."""

import collections

import pytest

from roadlark.llm import jaccard, mixing, pii, quality
from tests.llm.conftest import prose


def test_line_limit_does_not_rise_with_the_host(spark):
    menu = "Home | News | About | Contact"
    rows = [(i, f"{prose(i, 60)}\n{menu}", "large") for i in range(30)] + [(i, prose(i, 60), "large") for i in range(30, 900)]
    rows += [(2000 + i, f"{prose(2000 + i, 60)}\n{menu}", "rare") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["n_removed_words"] for r in quality.score(docs).collect()}
    assert all(out[i] == 7 for i in range(30))
    assert not any(out[i] for i in range(30, 900)) and not any(out[2000 + i] for i in range(20))
    texts = {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()}
    assert "About" not in texts[0] and "About" in texts[2000] and texts[500] == rows[500][1]


def test_callers_columns_come_back(spark):
    """Columns of the caller may have any name that the operators use inside."""
    names = ["key", "taken", "rows", "turn", "host", "th", "gone", "lost", "in_texts", "found", "row_key", "row", "body", "bucket", "block", "place", "name", "n_taken", "_key", "_n", "_turn", "_host", "_th", "_gone", "_lost", "_copies", "_w", "copies", "line", "words", "base", "terms", "node", "n", "kind", "label", "cum", "size", "target", "_text", "_id"]
    menu = "Home | News | About | Contact"
    rows = [(i, f"{prose(i, 60)} jo{i}@mail.example.com\n{menu}", "s", *[f"{n}-{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for step in (quality.clean, jaccard.keep_one, pii.sanitise, mixing.mixed, quality.score):
        out = step(docs)
        assert out.columns[: len(docs.columns)] == docs.columns, step
        found = out.collect()
        assert found and all(r[n] == f"{n}-{r['doc_id']}" for r in found for n in names), step


def test_components_reach_the_fixed_point(spark):
    from roadlark.llm.common import Scratch
    from roadlark.llm.components import components

    edges = [(i, i + 1) for i in range(700)] + [(2000, 2000 + i) for i in range(1, 300)] + [(5000 + i * 37 % 91, 5000 + i) for i in range(91)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    u = {}

    def root(x):
        while u.setdefault(x, x) != x:
            x = u[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            u[b] = a
    least = collections.defaultdict(lambda: 1 << 60)
    for x in list(u):
        least[root(x)] = min(least[root(x)], x)
    assert found == {x: least[root(x)] for x in u if sum(root(y) == root(x) for y in u) > 1}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from roadlark.llm import common

    class Remote:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        common.shared_dir(Remote)
