"""The encoding of a CSV is that of its whole content, not of its head."""

from tessaria.sources import csv_upload


def test_accents_behind_a_long_ascii_head(spark, tmp_path):
    plain = [(f"{i}", "plain") for i in range(12_000)]
    rows = [*plain, ("a", "São Paulo"), ("b", "Ceará"), ("c", "maçã")]
    text = "id;city\n" + "".join(f"{a};{b}\n" for a, b in rows)
    assert len(text) > 8 * csv_upload.SAMPLE and text[: 4 * csv_upload.SAMPLE].isascii()
    for encoding in ("latin-1", "utf-8", "utf-8-sig"):
        df = csv_upload.read_csv_bytes(spark, text.encode(encoding), str(tmp_path))
        assert df.columns == ["id", "city"]
        assert sorted(map(tuple, df.collect())) == sorted(rows), encoding


def test_line_breaks_inside_quotes_behind_the_sample(spark, tmp_path):
    """Files are split unless a quoted value holds a line break, wherever it is."""
    rows = [(f"{i}", "short") for i in range(12_000)]
    text = "id,said\n" + "".join(f"{a},{b}\n" for a, b in rows)
    df = csv_upload.read_csv_bytes(spark, text.encode(), str(tmp_path))
    assert df.count() == len(rows)
    df = csv_upload.read_csv_bytes(spark, (text + 'x,"two\nlines, ""quoted"""\n').encode(), str(tmp_path))
    assert df.count() == len(rows) + 1 and df.where("id = 'x'").first().said == 'two\nlines, "quoted"'


def test_folder_and_missing_file(spark, tmp_path):
    import pytest

    (tmp_path / "in").mkdir()
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.csv").write_text(f"a|b\n{i}|x\n")
    assert sorted(r.a for r in csv_upload.read_csv(spark, f"file://{tmp_path}/in").collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        csv_upload.read_csv(spark, f"file://{tmp_path}/none.csv")
