"""Documents written as one file each, and read back as whole texts."""

import os

from pyspark.sql import functions as F

from ticketlens.sources import documents as do


def test_one_file_a_key_in_folders_of_many(spark, tmp_path):
    texts = {n: f"# Text {n}\n\n- **Manual steps:** step {n}" for n in range(40)} | {-5: ""}
    rows = spark.createDataFrame(list(texts.items()), "batch_id bigint, text string").repartition(3)
    path = str(tmp_path / "documents")
    do.write_documents(rows, path, "batch_id")
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".txt")]
    assert len(files) == len(texts)
    assert all("/group=" in f and "/batch_id=" in f for f in files)
    number = F.regexp_extract("path", "batch_id=(-?[0-9]+)", 1).cast("bigint")
    read = do.read_documents(spark, path, nested=True).select(number.alias("batch_id"), "text").collect()
    assert {r.batch_id: r.text for r in read} == texts


def test_files_of_a_plain_folder_are_read_as_before(spark, tmp_path):
    (tmp_path / "one.txt").write_text("  first\nsecond \n")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "two.txt").write_text("third")
    assert [r.text for r in do.read_documents(spark, str(tmp_path)).collect()] == ["first\nsecond"]
    assert sorted(r.text for r in do.read_documents(spark, str(tmp_path), nested=True).collect()) == ["first\nsecond", "third"]
