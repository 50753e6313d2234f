"""Row counts of the employee workload, through the store, before and after commits."""

from chronofact.plans import workload
from chronofact.sources import store
from chronofact.sources.store import FactStore, local_root


def test_row_counts(spark, tmp_path):
    n = 400
    s = workload.load(spark, n, local_root(f"{tmp_path}/facts"))
    counts = {k: call().count() for k, call in workload.queries(workload.view(s), n).items()}
    assert counts == {"q1_entity_lookup": 10, "q2_attribute_scan": n, "q3_type_filter": n, "q4_attribute_value": n // 8, "q5_ref_lookup": 1, "q6_boolean_filter": n * 9 // 10, "d1_one_pattern": n, "d2_two_patterns": n, "d3_join_predicate": counts["d3_join_predicate"], "d4_bound_value": n // 8, "d5_group_count": 8, "d6_ref_traversal": n // 5 - 1}
    assert 0 < counts["d3_join_predicate"] < n
    workload.commit(s, 30)
    assert workload.update(s, 0, 20) == 100
    after = {k: call().count() for k, call in workload.queries(workload.view(s), n).items()}
    assert {k: v for k, v in after.items() if counts[k] != v} == {"q6_boolean_filter": n * 9 // 10 - 8}


def test_long_tails_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD_COMMITS", 7)
    s = FactStore(spark, local_root(str(tmp_path)))
    workload.commit(s, 20)
    assert len(s.files.names(f"{s.root}/runs")) == 2 and len(s._tail) == 6
    assert s.current_position() == FactStore(spark, s.root).current_position() == 20
    assert s.match(attribute=":day").count() == 20 and s.log().count() == 20
    s.compact()
    assert s.vacuum() == 3 and s.match(attribute=":day").count() == 20 and s.transactions().count() == 20
