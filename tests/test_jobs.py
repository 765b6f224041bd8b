"""The jobs: growing input, failures half-way, reruns, and results against plain Python."""

import json
import logging
import os
import re
import subprocess
import sys

import pytest

from jobs import literature_evidence as lit
from jobs import section_atlas as atlas
from jobs.settings import read_config, settings

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TERMS = [("Notch", "NOTCH1"), ("delta", "DLL1"), ("delta", "DLL4"), ("il6", "IL6.2"), ("receptor-six", "il6r"), ("x", "SHORT")]
PAIRS = [("DLL1", "NOTCH1", "notch", "Cell-Cell Contact"), ("dll4", "NOTCH1", "notch", "Cell-Cell Contact"), ("IL6", "IL6R", "", "Secreted Signaling"), ("COMPLEX:A", "NOTCH1", "notch", ""), ("DLL1", "NOTCH1", "notch", "Cell-Cell Contact"), ("IL6", "IL6", "auto", None)]
DOCS = [
    (1, "Delta binds notch on the membrane. IL6 is secreted and meets Receptor-Six!\nNotch alone. ", "a"),
    (2, "delta; notch; delta", "b"), (3, None, "a"), (4, "", "a"), (5, "Notch? Delta.", None), (6, "soluble delta near notch. Delta, notch and contact", "a"),
    (None, "delta with notch, adhesion", None), (None, "delta with notch, adhesion", "c"), (7, "il6 " * 20_000 + "receptor-six", "b"), (2, "delta; notch; delta", "b"),
]
COLS = ("pathway", "ligand", "receptor", "n_docs", "n_sentences", "n_sources", "n_membrane", "n_secreted", "mode")


def plain(docs):
    """The summary in plain Python."""
    genes = {"notch": {"NOTCH1"}, "delta": {"DLL1", "DLL4"}, "il6": {"IL6"}, "receptor-six": {"IL6R"}}
    pairs = {("notch", "DLL1", "NOTCH1"), ("notch", "DLL4", "NOTCH1"), ("unknown", "IL6", "IL6R"), ("auto", "IL6", "IL6")}
    found = {}
    for i, text, source in docs:
        for k, s in enumerate(re.split(r"[.!?\n]+", text or "")):
            low = s.lower()
            own = set().union(*(genes.get(w, set()) for w in re.findall("[a-z0-9-]+", low)))
            mode = "mb" if re.search("membrane|contact|adhesion", low) else "secreted" if re.search("secreted|soluble", low) else None
            for p in pairs:
                if {p[1], p[2]} <= own:
                    found.setdefault(p, {}).setdefault((i if i is not None else text, k), []).append((source or "unknown", mode))
    out = []
    for p, rows in found.items():
        modes = [min((m for _, m in v if m), default=None) for v in rows.values()]
        mb, sec = modes.count("mb"), modes.count("secreted")
        out.append((*p, len({d for d, _ in rows}), len(rows), len({min(s for s, _ in v) for v in rows.values()}), mb, sec, "mb" if mb > sec else "secreted" if sec > mb else None))
    return sorted(out, key=str)


def rows(df, cols=COLS):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


class Folder:
    """A job's inputs and outputs in a folder of the test's own."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        spark.createDataFrame(TERMS, "term string, gene string").write.option("header", True).csv(f"{self.path}/terms.csv")
        spark.createDataFrame(PAIRS, "ligand string, receptor string, pathway string, ligand_annotation string").write.parquet(f"{self.path}/pairs")

    def add(self, docs):
        self.spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumnRenamed("doc_id", "doc_id").coalesce(1).write.mode("append").parquet(f"{self.path}/docs")

    def run(self, **config):
        return lit.run(self.spark, f"{self.path}/docs", f"{self.path}/terms.csv", f"{self.path}/pairs", f"{self.path}/out", f"{self.path}/check", config)

    def stamps(self, table):
        return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{self.path}/out/{table}") for f in fs if f.startswith("part-")}


def test_evidence_over_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    f = Folder(spark, tmp_path)
    f.add(DOCS[:3])
    assert rows(f.run()) == plain(DOCS[:3])
    assert "read 3 documents" in caplog.text
    before = f.stamps("summary")
    f.add([(8, "delta meets notch in contact", "d")])
    assert rows(f.run()) == plain([*DOCS[:3], (8, "delta meets notch in contact", "d")])
    same = {k for k, v in f.stamps("summary").items() if before.get(k) == v}
    assert same and all("pathway=notch" not in k for k in same)  # pathways without new evidence aren't touched
    caplog.clear()
    f.add(DOCS[3:])
    assert rows(f.run()) == plain([*DOCS, (8, "delta meets notch in contact", "d")])
    assert f"read {len(DOCS) - 3} documents" in caplog.text
    before = f.stamps("summary") | f.stamps("evidence")
    assert rows(f.run()) == plain([*DOCS, (8, "delta meets notch in contact", "d")])
    assert f.stamps("summary") | f.stamps("evidence") == before  # nothing new: nothing written


def test_evidence_in_many_batches_equals_one(spark, tmp_path):
    f = Folder(spark, tmp_path)
    for d in DOCS:
        f.add([d])
    assert rows(f.run(files_per_batch=2)) == plain(DOCS)


@pytest.mark.parametrize("place", ["summary", "write"])
def test_evidence_after_a_failure(spark, tmp_path, monkeypatch, place):
    """A batch that fails before or after its evidence is written is taken again, and counts once."""
    f = Folder(spark, tmp_path)
    f.add(DOCS[:6])
    real, calls = getattr(lit, place), []

    def broken(*a):
        calls.append(1)
        if place == "write" and len(calls) < 2:
            return real(*a)
        raise RuntimeError("lost")

    monkeypatch.setattr(lit, place, broken)
    with pytest.raises(Exception, match="lost"):
        f.run()
    monkeypatch.setattr(lit, place, real)
    f.add(DOCS[6:])
    assert rows(f.run()) == plain(DOCS)


def test_evidence_without_any(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add([(1, "nothing here", "a"), (2, None, None)])
    assert rows(f.run()) == []
    f.add([(3, "notch, delta", "a")])
    assert rows(f.run()) == plain([(3, "notch, delta", "a")])


def test_settings_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        settings({"a": 1}, {"b": 2})
    for name, known in (("literature_evidence", lit.DEFAULTS), ("section_atlas", atlas.DEFAULTS)):
        assert settings(known, read_config(spark, f"{REPO}/jobs/{name}.json")) == known


def test_command_line(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add(DOCS)
    (tmp_path / "conf.json").write_text(json.dumps({"files_per_batch": 1}))
    options = {"documents": "docs", "terms": "terms.csv", "pairs": "pairs", "output": "out", "checkpoint": "check", "config": "conf.json"}
    command = [sys.executable, "-m", "jobs.literature_evidence", *(x for k, v in options.items() for x in (f"--{k}", f"{f.path}/{v}"))]
    env = os.environ | {"PYTHONPATH": REPO, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run(command, env=env, cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "run over" in done.stderr
    assert rows(spark.read.schema(lit.SUMMARY).parquet(f"{f.path}/out/summary")) == plain(DOCS)


# --- section atlas

SECTIONS = ("n_edges", "total", "mean", "share", "spots", "edges", "h")


def tissue(spark, path, sections="AB", extra=()):
    """Two lattices of 5 by 5 spots with four genes."""
    spots = [(100 * k + 5 * i + j, float(i), j + 0.1 * k, s) for k, s in enumerate(sections) for i in range(5) for j in range(5)]
    expr = [(i, g, float((i * 7 + n * 3) % 5)) for i, *_ in spots for n, g in enumerate(("L1", "R1", "l2.1", "R2")) if (i + n) % 3]
    lr = [("L1", "R1", "p", "Secreted Signaling"), ("L2", "R2", "q", "Cell-Cell Contact"), ("L1", "R2", "q", "Secreted Signaling"), ("L9", "R1", "p", "x"), ("A_B", "R1", "p", "x")]
    spark.createDataFrame([*spots, *extra], "spot_id bigint, x double, y double, section string").write.mode("overwrite").parquet(f"{path}/spots")
    spark.createDataFrame(expr, "spot_id bigint, gene string, value double").write.mode("overwrite").parquet(f"{path}/expr")
    spark.createDataFrame(lr, "ligand string, receptor string, pathway string, ligand_annotation string").write.mode("overwrite").parquet(f"{path}/pairs")
    return lambda **config: atlas.run(spark, f"{path}/spots", f"{path}/expr", f"{path}/pairs", f"{path}/out", config=config)


def told(df):
    return {(r.section, r.pathway): tuple(round(r[c], 9) for c in SECTIONS) for r in df.collect()}


def test_atlas_rejects_spots_and_reruns(spark, tmp_path):
    odd = [(None, 0.0, 0.0, "A"), (900, float("nan"), 1.0, "A"), (901, 1.0, None, "B"), (902, 1.0, 1.0, " "), (903, 2.0, 2.0, "A"), (903, 3.0, 3.0, "B"), (904, float("inf"), 0.0, "A")]
    clean = told(tissue(spark, tmp_path / "clean")())
    run = tissue(spark, tmp_path / "odd", extra=odd)
    assert told(run()) == clean and clean
    out = spark.read.parquet(f"{tmp_path}/odd/out/rejected").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in out} == {"no_id": 1, "no_place": 3, "no_section": 1, "repeated": 2}
    assert told(run()) == clean


def test_atlas_sections_are_independent(spark, tmp_path):
    both = told(tissue(spark, tmp_path / "both")())
    one = told(tissue(spark, tmp_path / "one", "A")())
    assert {k: v[4:] for k, v in both.items() if k[0] == "A"} == {k: v[4:] for k, v in one.items()}  # spots, edges, spacing


def test_atlas_of_chosen_sections_leaves_others(spark, tmp_path):
    run = tissue(spark, tmp_path)
    before = told(run())
    assert {s for s, _ in before} == {"A", "B"}
    after = told(run(sections=["B"], keep=0.9))
    assert {k: v for k, v in after.items() if k[0] == "A"} == {k: v for k, v in before.items() if k[0] == "A"}
    assert any(after[k] != before[k] for k in after if k[0] == "B")
    assert told(run(sections=["B"])) == before


def test_atlas_of_nothing(spark, tmp_path):
    run = tissue(spark, tmp_path)
    run()
    spark.createDataFrame([], "spot_id bigint, x double, y double, section string").write.mode("overwrite").parquet(f"{tmp_path}/spots")
    assert run().count() == 0
