"""Uploads in packs: as many files as tasks write, whatever the number of uploads."""

import glob

from rosterlake.catalogue_parses import landed_files
from rosterlake.sources.tables import landing_zone, pack_files
from rosterlake.sources.work import session_dir


def test_packs_are_taken_in_like_files(spark, tmp_path):
    rows = [("/a/x.txt", b"hello\n"), ("/b/x.txt", b"hello\n"), ("/a/y.TXT", b"y" * 99), ("/a/z.csv", b"no"), ("/txt", b"")]
    pack_files(spark.createDataFrame(rows, "path string, content binary"), f"{tmp_path}/packs")
    good, bad = landing_zone(spark, f"{tmp_path}/packs", largest=50, packed=True)
    assert sorted((r.path, r.file_name, r.file_size, r.file_type, r.raw_text) for r in good.collect()) == [("/a/x.txt", "x.txt", 6, "txt", "hello\n"), ("/b/x.txt", "x.txt", 6, "txt", "hello\n")]
    assert sorted((r.path, r.reason) for r in bad.collect()) == [("/a/y.TXT", "too large"), ("/a/z.csv", "kind"), ("/txt", "kind")]
    assert "content" not in bad._jdf.queryExecution().executedPlan().toString()


def test_uploads_do_not_cost_a_file_each(spark, sf):
    folder = session_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/landing-*/**/*", recursive=True))
    uploads = landed_files(spark, sf).count()
    assert uploads == 150 and len(set(glob.glob(f"{folder}/landing-*/**/*", recursive=True)) - before) < 30
