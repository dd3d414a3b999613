"""Union schemas from stored file schemas."""

import os

import pytest

from ledgersight.sources import readers
from ledgersight.sources.schemas import SchemaRegistry


def write(spark, path, columns, *rows):
    spark.createDataFrame(list(rows), columns).coalesce(1).write.mode("overwrite").parquet(path)


def test_only_new_and_changed_files_are_opened(spark, tmp_path):
    a, b, c = (str(tmp_path / f"{n}.parquet") for n in "abc")
    write(spark, a, "id bigint, x int", (1, 2))
    write(spark, b, "id bigint, y string", (3, "p"))
    registry = SchemaRegistry(spark, str(tmp_path / "registry"))
    schema, opened = registry.schema([a, b])
    assert (schema.names, opened) == (["id", "x", "y"], 2)
    assert registry.schema([a, b]) == (schema, 0)
    write(spark, c, "id bigint, z double", (4, 5.0))
    schema, opened = registry.schema([a, b, c])
    assert (schema.names, opened) == (["id", "x", "y", "z"], 1)
    got = {tuple(r) for r in registry.read([a, b, c]).collect()}
    assert got == {(1, 2, None, None), (3, None, "p", None), (4, None, None, 5.0)}
    assert got == {tuple(r) for r in readers.read_events(spark, [a, b, c], tolerant=True).select("id", "x", "y", "z").collect()}
    # another file in its place is opened again
    write(spark, c, "id bigint, z double, w int", (4, 5.0, 6))
    assert registry.schema([a, b, c])[0].names == ["id", "x", "y", "z", "w"]


def test_columns_of_two_types_are_an_error(spark, tmp_path):
    a, b = (str(tmp_path / f"{n}.parquet") for n in "ab")
    write(spark, a, "id bigint, x int", (1, 2))
    write(spark, b, "id bigint, x string", (3, "p"))
    registry = SchemaRegistry(spark, str(tmp_path / "registry"))
    registry.schema([a])
    with pytest.raises(ValueError, match="x is int and string"):
        registry.schema([a, b])


def test_periods_read_through_a_registry(spark, tmp_path):
    write(spark, str(tmp_path / "train_part_1.parquet"), "event_id bigint, a int", (1, 2))
    write(spark, str(tmp_path / "train_part_2.parquet"), "event_id bigint, b int", (3, 4))
    store = str(tmp_path / "store")
    for _ in range(2):
        frames = readers.read_period_files(spark, str(tmp_path), registry=store)
        assert {tuple(r) for r in frames["train"].collect()} == {(1, 2, None), (3, None, 4)}
    assert os.listdir(store) == ["train"]
