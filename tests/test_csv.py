"""CSV files with line breaks in cells, read in many parts."""

import csv
import random

import pytest

from certus.sources import records


@pytest.mark.parametrize("part", [300, 10_000_000])
def test_rows_over_many_blocks(spark, tmp_path, part):
    rnd = random.Random(part)
    rows = []
    for i in range(300):
        cell = "".join(rnd.choice(['a', '"', ",", "\n", "{", "é", " ", "\n\n"]) for _ in range(rnd.randrange(0, 30)))
        rows.append((f"id{i}", f"[{cell}]"))
    for name, some in (("x", rows[:200]), ("y", rows[200:])):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(("content_id", "top_logprobs"))
            out.writerows(some)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [tuple(r)[:2] for r in records.read_csv(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(rows)


def test_line_ends_and_empty_files(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="") as f:
        f.write('content_id,top_logprobs\r\n1,"[""x""]"\r\n\r\n2,\r\n')
    open(tmp_path / "b.csv", "w").close()
    with open(tmp_path / "c.csv", "w") as f:
        f.write("content_id,top_logprobs\n")
    got = sorted(tuple(r)[:2] for r in records.read_csv(spark, str(tmp_path)).collect())
    assert got == [("1", '["x"]'), ("2", None)]
