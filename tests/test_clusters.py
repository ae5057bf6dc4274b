"""Which works are a person's, by whether the person's institutions are known; where the works were written; merged records."""

import pytest

from folioscope.operators import candidates as C
from folioscope.sources import records as A


@pytest.mark.parametrize(("known", "kept", "method"), [(True, {1, 2}, "institution_collaborator_cluster"), (False, {1, 2, 3}, "insufficient_evidence")])
def test_known_institutions_without_a_work_there(spark, known, kept, method):
    components = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 3, 3)], "scholar_id long, work_id long, component long")
    evidence = spark.createDataFrame([(7, 1, 2020, 2, False), (7, 2, 2020, 1, False), (7, 3, 2019, 1, False)], "scholar_id long, work_id long, year int, coauthors int, at_target boolean")
    anchors = spark.createDataFrame([], "scholar_id long, work_id long")
    targets = spark.createDataFrame([(7,)] if known else [], "scholar_id long")
    rows = C.primary_cluster(components, evidence, anchors, targets).collect()
    assert {r.work_id for r in rows if r.kept} == kept and {r.method for r in rows} == {method}


def test_fingerprint_affiliations(spark):
    works = spark.createDataFrame([(1, "d1", 2020, 9), (2, None, 2021, 5), (3, "d3", 2019, 1), (4, "d4", 2022, 0)], "work_id long, doi string, publication_year int, cited_by_count int")
    authorships = spark.createDataFrame([(w, 7) for w in (1, 2, 3, 4)], "work_id long, scholar_id long")
    bylines = [(7, 1, "I1", "Uni"), (7, 2, "I1", "Uni"), (7, 3, None, " Lab "), (7, 2, "I2", "Academy"), (7, 3, "I9", " "), (7, 4, "I3", "Late")]
    rows = C.fingerprint_affiliations(works, authorships, spark.createDataFrame(bylines, "scholar_id long, work_id long, institution_id string, name string"), k=3).orderBy("place").collect()
    assert [(r.name, list(r.years), r.work_count) for r in rows] == [("Uni", [2021, 2020], 2), ("Academy", [2021], 1), ("Lab", [2019], 1)]


def test_merged_works_keep_verified_dates_and_types(spark):
    schema = "work_id long, title string, publication_date string, publication_year int, venue string, work_type string, abstract string, cited_by_count int, verified boolean, confidence double"
    current = spark.createDataFrame([(1, "a", "2020-01-02", 2020, None, "article", "x", 3, True, 0.9), (2, "b", None, 2021, "v", None, None, 1, False, 0.2)], schema)
    batch = spark.createDataFrame([(1, "A", "2021-01-01", 2021, "w", "preprint", None, 5, False, 0.5), (2, "B", "2021-05-05", 2021, None, "book", "y", 0, False, 0.1)], schema)
    merge = lambda c: {r.work_id: r for r in A.merge_works(c, batch).collect()}
    got = merge(current)
    assert (got[1].publication_date, got[1].work_type, got[1].venue, got[1].abstract, got[1].cited_by_count) == ("2020-01-02", "article", "w", "x", 5)
    assert (got[2].publication_date, got[2].work_type, got[2].venue) == ("2021-05-05", "book", "v")
    assert merge(A.merge_works(current, batch)) == got  # the same batch again changes nothing
