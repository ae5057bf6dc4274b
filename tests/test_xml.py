"""Bibliography files read record by record, in several tasks, with the entities of their DTD."""

import pytest

from folioscope.sources import external as X


def test_records_of_files(spark, tmp_path):
    head = '<?xml version="1.0"?>\n<!DOCTYPE dblpperson SYSTEM "dblp.dtd">\n<dblpperson name="x">\n<person key="p"><author>A</author></person>\n'
    record = "<r><article key='k{n}'><author>J&ouml;rg &amp; S&otilde;n</author><title>On <i>R&amp;D</i> &#252; &unknown; AT&amp;T {n}.</title><year>{y}</year>\n<journal>J {n}</journal><ee>https://doi.org/10.1/A{n}</ee></article></r>\n"
    body = "".join(record.format(n=n, y=2000 + n % 20) for n in range(900))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(head + body + "<r/></dblpperson>")
    (tmp_path / "in" / "b.xml").write_text(head + "<r><person/></r><r></r></dblpperson>")
    (tmp_path / "d.dtd").write_text("<!ENTITY ouml   \"&#246;\" ><!-- x -->\n<!ENTITY otilde '&#245;'>\n<!ELEMENT r ANY>")
    entities = X.declared_entities(spark, f"{tmp_path}/d.dtd")
    assert entities == {"ouml": "&#246;", "otilde": "&#245;"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        found = X.person_record_files(spark, f"{tmp_path}/in", entities)
        assert found.rdd.getNumPartitions() > 4
        rows = {r.key: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(rows) == {f"k{n}" for n in range(900)} | {""}
    assert all(tuple(rows[f"k{n}"])[1:] == (f"10.1/a{n}", f"On R&D \u00fc &unknown; AT&T {n}.", 2000 + n % 20, f"J {n}", ["J\u00f6rg & S\u00f5n"]) for n in range(900))


def test_markup_and_references_of_records(spark):
    entry = (
        "text <!-- <book> --><article key='k&amp;1' mdate=\"2\"><author pid='x'>A  B</author><author/><author>C &#60; D</author><title>On <i>R&amp;D</i>&#x20;&lt;b&gt; &amp;lt; <sub a=\"q>\">2</sub>.</title>"
        "<title>second</title><year>2001</year><ee>https://x.org/a</ee><ee type='oa'>https://doi.org/10.1/A&amp;1</ee><journal> <!-- none --> </journal><booktitle><![CDATA[J <x> &amp; 1]]> b</booktitle></article><note>n</note>"
    )
    raw = spark.createDataFrame([(f"<dblpperson><r>{entry}</r><r><!-- <a/> --></r><r/><r><www/></r></dblpperson>",), (None,)], "xml string")
    found = sorted(tuple(r) for r in X.person_records_xml(raw).collect())
    assert found == [("", "", "", None, "", []), ("k&1", "10.1/a&1", "On R&D <b> &lt; 2.", 2001, "J <x> &amp; 1 b", ["A B", "C < D"])]


def test_records_are_parsed_once(spark):
    raw = spark.createDataFrame([("<dblpperson><r><article key='k'><title>t</title></article></r></dblpperson>",)], "xml string")
    plan = X.person_records_xml(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and "xpath" not in plan


def test_malformed_records_fail(spark):
    raw = spark.createDataFrame([("<dblpperson><r><article key='k'><title>t</article></r></dblpperson>",)], "xml string")
    with pytest.raises(Exception, match="MALFORMED"):
        X.person_records_xml(raw).collect()
