import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import rdf
from graphloom.sources.rdf_source import RdfSource


@pytest.fixture(scope="module")
def rdf_format(spark):
    spark.dataSource.register(RdfSource)
    return lambda **o: spark.read.format("rdf").options(**o)


def written(path, n=300):
    rng, lines = random.Random(4), []
    for i in range(n):
        o = rng.choice([f"<http://x/o{i}>", f"_:b{i % 7}", f'"text {i} \\"é\\n\\u00e9\\U0001F600"', f'"w{i}"@EN-gb', f'"{i}"^^<http://x/int>'])
        lines.append(f"<http://x/s{i % 50}> <http://x/p{i % 3}> {o} ." + rng.choice(["", " # said", "   "]))
        lines += rng.choice([[], [""], ["# a comment"]])
    path.write_text("\n".join(lines) + rng.choice(["", "\n"]), encoding="utf-8")
    return lines


def key(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in rdf.TRIPLE.split(", ")]).collect()))


@pytest.mark.parametrize("split", ["1000000", "4096", "97", "1"])
def test_ranges_give_each_line_once(spark, rdf_format, tmp_path, split):
    written(tmp_path / "a.nt", 60 if split == "1" else 300)
    written(tmp_path / "b.nt", 0 if split == "1" else 40)
    got = rdf_format(splitBytes=split).load(str(tmp_path)) if split != "1" else rdf_format(splitBytes="50").load(str(tmp_path))
    assert key(got) == key(rdf.read_files(spark, str(tmp_path), "nt"))


def test_one_byte_ranges(tmp_path):
    from graphloom.sources.rdf_source import RdfReader

    lines = written(tmp_path / "a.nt", 20)
    reader = RdfReader({"path": f"file://{tmp_path}/a.nt", "splitBytes": "1"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == sum(x.startswith("<") for x in lines)


def test_bad_lines(rdf_format, tmp_path):
    (tmp_path / "a.nt").write_text("<a> <b> <c> .\nnonsense\n<a> <b> <d> .\n")
    with pytest.raises(Exception, match="not a triple: nonsense"):
        rdf_format().load(str(tmp_path)).count()
    assert {r.o for r in rdf_format(mode="DROPMALFORMED").load(str(tmp_path)).collect()} == {"c", "d"}
    with pytest.raises(Exception, match="no mode"):
        rdf_format(mode="x").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="nowhere"):
        rdf_format().load(str(tmp_path / "nowhere")).count()


def test_documents_and_formats(spark, rdf_format, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix x: <http://x/> . x:a x:p [ x:q 1, 2 ] ; x:l ( 'u' 'v' ) .")
    (tmp_path / "b.ttl").write_text("this is no turtle")
    (tmp_path / "c.nt").write_text("<http://x/a> <http://x/p> _:z .\n")
    (tmp_path / "_skip.ttl").write_text("nor this")
    (tmp_path / "empty.nt").write_text("")
    out = rdf_format(mode="dropmalformed").load(str(tmp_path)).collect()
    assert len(out) == 9 and {r.doc_id for r in out} == {"a.ttl", "c.nt"} and {r.o for r in out if r.doc_id == "c.nt"} == {"c.nt:z"}
    assert key(rdf_format().load(str(tmp_path / "a*.ttl"))) == key(rdf.read_files(spark, str(tmp_path / "a.ttl")))
    assert rdf_format().load(str(tmp_path / "empty.nt")).count() == 0
    with pytest.raises(Exception, match="b.ttl"):
        rdf_format().load(str(tmp_path)).count()


def test_pushed_predicates(spark, rdf_format, tmp_path):
    written(tmp_path / "a.nt")
    every = rdf.read_files(spark, str(tmp_path), "nt")
    assert key(rdf_format(predicates="http://x/p1 http://x/p2").load(str(tmp_path))) == key(every.where("p in ('http://x/p1', 'http://x/p2')"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = rdf_format(pushdown="true").load(str(tmp_path)).where((F.col("p") == "http://x/p1") & F.col("o_kind").isin("iri", "literal") & F.col("o").like("%1%"))
        assert key(df) == key(every.where("p = 'http://x/p1' and o_kind in ('iri', 'literal') and o like '%1%'"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
