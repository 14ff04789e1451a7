"""Registered queries against their SQL, the driver's contract, and the file tasks."""

from __future__ import annotations

import ast
import random
import sys
from pathlib import Path

import duckdb
import pytest

from seqlattice import jobs, tasks
from seqlattice.plans import registry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()

needs_data = pytest.mark.skipif(not DATA.exists(), reason="the warehouse tables are not here")


def normal(frame):
    names = sorted(frame.columns)
    rows = [tuple(None if str(x) in ("<NA>", "nan", "NaT", "None") else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r) for r in frame[names].astype(object).values.tolist()]
    return names, sorted(rows, key=str)


#: Their SQL solves designs of full rank, which the smallest tables do not give everywhere.
FULL_RANK = {"OP-2_affinity", "OP-3_best_windows", "OP-3_variant_rows", "OP-4_against_background", "OP-6_scan", "OP-8_holm_scan"}


@pytest.fixture(scope="module")
def warehouse():
    found = {}
    for folder in (DATA, DATA.parent / "sf0.01"):
        found[folder] = con = duckdb.connect()
        for f in folder.glob("*.parquet"):
            con.sql(f"create view {f.stem} as select * from '{f}'")
    return found


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, warehouse, name):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    data = DATA.parent / "sf0.01" if name in FULL_RANK else DATA
    assert normal(registry.queries()[name](spark, str(data)).toPandas()) == normal(warehouse[data].sql(SQL[name]).df())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0


def test_entry_offers_all_queries():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    for f in (ROOT / "seqlattice").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


# -- tasks over files -------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A genome of one contig, regions, values that favour one base, variants, a signal track."""
    d, rng = tmp_path_factory.mktemp("files"), random.Random(12)
    genome = "".join(rng.choice("ACGT") for _ in range(6000))
    (d / "genome.fa").write_text(">chr1\n" + genome + "\n")
    regions = sorted({(s, s + rng.randint(18, 30)) for s in (rng.randrange(0, 5900) for _ in range(260))})
    (d / "regions.bed").write_text("".join(f"chr1\t{s}\t{e}\n" for s, e in regions))
    value = {(s, e): rng.gauss(0, 0.3) + ("ACGT" in genome[s:e]) - ("ATGT" in genome[s:e]) for s, e in regions}
    (d / "values.tsv").write_text("".join(f"chr1:{s}-{e}\t{v}\n" for (s, e), v in value.items()))
    (d / "signal.bg").write_text("".join(f"chr1\t{i}\t{i + 50}\t{rng.random() * 9}\n" for i in range(0, 6000, 50)))
    comp = {"A": "C", "C": "A", "G": "T", "T": "G"}
    (d / "variants.txt").write_text("".join(f"chr1:{p}:{genome[p - 1]}>{comp[genome[p - 1]]}\n" for p in (101, 250, 333)) + "\nchr1:400:N>A\n")
    return d


@pytest.fixture(scope="module")
def array(spark, folder):
    out = str(folder / "array")
    tasks.run_array(spark, tasks.ArrayOptions(bed=str(folder / "regions.bed"), genome=str(folder / "genome.fa"), output=out, kmer_size=4))
    return out


def common(folder, array):
    return {"intensities": str(folder / "values.tsv"), "array": array, "genome": str(folder / "genome.fa"), "kmer_size": 4, "rand_n": 20}


@pytest.mark.parametrize("rng", ["seeded", "hash"])
def test_variant_report(spark, folder, array, rng):
    o = tasks.VariantOptions(**common(folder, array), snv_list_file=str(folder / "variants.txt"), rng=rng)
    lines = tasks.run_variants(spark, o).splitlines()
    assert lines[0].split("\t") == ["snv", "type", "allele", "motif_pos", "wildcard_kmer", "effect", "pval"]
    assert {x.split("\t")[1] for x in lines[1:]} == {"AFF", "RAND"} and len(lines) > 20
    assert lines == tasks.run_variants(spark, o).splitlines()


def test_best_windows_with_a_cap(spark, folder, array):
    o = tasks.VariantOptions(**common(folder, array), snv_list_file=str(folder / "variants.txt"), best_pval=True, holm=True, diagnostics=True, max_probes=30, seed=7)
    lines = [x.split("\t") for x in tasks.run_variants(spark, o).splitlines()]
    assert len(lines) == 10 and lines[0][-4:] == ["motif_pos", "wildcard_kmer", "n_probes", "n_allele"]
    assert all(float(x[4]) >= float(x[5]) for x in lines[1:] if x[4] != "NA" and not x[4].startswith("<"))


def test_masked_variants(spark, folder, array):
    o = tasks.VariantOptions(**common(folder, array) | {"array": None}, snv_list_file=str(folder / "variants.txt"), mask="1101")
    assert "x" in tasks.run_variants(spark, o).splitlines()[1].split("\t")[4]


@pytest.mark.parametrize("extra", [{}, {"best_pval": True}, {"pooled": True}, {"reverse": True}, {"mode": "nb"}])
def test_scan_reports(spark, folder, array, extra):
    lines = tasks.run_scan(spark, tasks.ScanOptions(**common(folder, array), region="chr1:101-108", **extra)).splitlines()
    assert lines[0].split("\t") == tasks.SCAN_COLUMNS and len(lines) > 10


def test_holm_scan_covers_every_base(spark, folder, array):
    text = tasks.run_scan(spark, tasks.ScanOptions(**common(folder, array), region="chr1:101-103", best_pval=True, holm=True))
    assert len(text.splitlines()) == 1 + 3 * 3 * 3


def test_intensities_of_a_track(spark, folder):
    o = tasks.IntensityOptions(bed=str(folder / "regions.bed"), signal=str(folder / "signal.bg"), output=str(folder / "out"), genome=str(folder / "genome.fa"), resid_use_length=True)
    rows = tasks.run_intensities(spark, o).collect()
    assert abs(sum(r["value"] for r in rows)) < 1e-6


def test_motifs_and_caps(spark, folder, array):
    o = {"intensities": str(folder / "values.tsv"), "array": array, "kmer_size": 4}
    found = tasks.run_motifs(spark, tasks.MotifOptions(**o, min_F=5, min_per_base=2, max_gaps=1, extend_left=1, extend_right=1))
    assert found["meme"].startswith("MEME version 4") and len(found["ppm"]) >= 4
    caps = tasks.run_caps(spark, tasks.CapOptions(**o, caps="20,30", n_families=4, repeats=3, min_probes=15))
    assert set(caps) == {"recommendation", "summary", "family_curves", "contrasts", "pvalue_quartiles"} and len(caps["summary"]) == 2


def test_masked_motif_and_mask_calibration(spark, folder):
    o = {"intensities": str(folder / "values.tsv"), "genome": str(folder / "genome.fa")}
    found = tasks.run_motifs(spark, tasks.MotifOptions(**o, mask="1101", min_F=5, min_per_base=2))
    assert found["ppm"].iloc[2].tolist()[1:] == [0.25] * 4 and found["consensus"][2] == "."
    masks = tasks.run_masks(spark, tasks.MaskOptions(**o, masks="1101", random_controls=0, n_families=3, stability_probes=15, min_probes=10, repeats=3))
    assert len(masks["summary"]) == 1


def test_options_are_checked():
    for bad in ({}, {"bed": "x", "genome": "y"}):
        with pytest.raises(tasks.OptionError):
            tasks.ArrayOptions(**bad)
    with pytest.raises(tasks.OptionError):
        tasks.VariantOptions(intensities="i", genome="g", array="a", snv_list="x", diagnostics=True)
    with pytest.raises(tasks.OptionError):
        tasks.ScanOptions(intensities="i", genome="g", array="a", region="r", holm=True)


# -- jobs ----------------------------------------------------------------------------------


def test_jobs_resolve_paths_and_reject_unknown_keys(tmp_path):
    (tmp_path / "a.yaml").write_text("task: snv\ninputs: {intensities: i.tsv, variants: v.txt}\nparameters: {kmer_size: 4}\noutput: {stdout: out/x.tsv}\n")
    job = jobs.load(tmp_path / "a.yaml")
    assert job["options"] == {"intensities": str(tmp_path / "i.tsv"), "snv_list_file": str(tmp_path / "v.txt"), "kmer_size": 4} and job["stdout"] == str(tmp_path / "out/x.tsv")
    for text in ("task: snv\nparameters: {none: 1}\n", "task: none\n", "- 1\n", "task: snv\nother: 1\n", "task: pipeline\nsteps: []\n"):
        (tmp_path / "b.yaml").write_text(text)
        with pytest.raises(jobs.JobError):
            jobs.load(tmp_path / "b.yaml")


def test_pipelines_stop_at_cycles(tmp_path):
    (tmp_path / "p.yaml").write_text("task: pipeline\nsteps: [p.yaml]\n")
    with pytest.raises(jobs.JobError):
        jobs.run_file(None, str(tmp_path / "p.yaml"))


def test_templates_and_dry_runs(tmp_path, capsys):
    for name in [*jobs.TASKS, "pipeline"]:
        (tmp_path / "t.yaml").write_text(jobs.template(name))
        assert jobs.load(tmp_path / "t.yaml")["task"] == name
    (tmp_path / "t.yaml").write_text("task: array\ninputs: {bed: b}\n")
    assert jobs.main(["run", "--dry-run", "--set", "kmer-size=5", str(tmp_path / "t.yaml")]) == 0
    assert "kmer_size=5" in capsys.readouterr().out
    assert jobs.main(["list"]) == 0 and jobs.main(["template", "snv"]) == 0
    assert jobs.main(["run", str(tmp_path / "missing.yaml")]) == 2


def test_a_job_writes_its_report(spark, folder, array):
    (folder / "job.yaml").write_text(f"task: scan\ninputs: {{intensities: values.tsv, array: {array}, genome: genome.fa}}\nparameters: {{kmer_size: 4, region: 'chr1:101-104'}}\noutput: {{stdout: scan.tsv}}\n")
    jobs.run_file(lambda: spark, str(folder / "job.yaml"), {"best_pval": True})
    assert (folder / "scan.tsv").read_text().startswith("wildcard_kmer")


def test_command_line_help():
    with pytest.raises(SystemExit) as e:
        jobs.main(["snv", "--help"])
    assert e.value.code == 0 and sys.modules["seqlattice.jobs"]
