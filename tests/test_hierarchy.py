"""Closures and depths of chains, lattices and cycles."""

import pytest

from skerry.operators import hierarchy


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "child int, parent int")


def test_a_lattice_with_two_parents_each(spark):
    """20 layers of two classes: a million paths from the bottom to the top."""
    rows = [(10 * k + i, 10 * (k + 1) + j) for k in range(19) for i in range(2) for j in range(2)]
    edges = edges_of(spark, rows)
    got = {(r.concept_id, r.ancestor) for r in hierarchy.closure(edges).collect()}
    assert got == {(10 * k + i, 10 * m + j) for k in range(20) for m in range(k + 1, 20) for i in range(2) for j in range(2)}
    concepts = spark.createDataFrame([(10 * k + i,) for k in range(20) for i in range(2)], "concept_id int")
    assert {r.concept_id: r.depth for r in hierarchy.depths(concepts, edges).collect()} == {10 * k + i: 19 - k for k in range(20) for i in range(2)}


def test_a_chain_of_200_levels(spark):
    edges = edges_of(spark, [(i, i + 1) for i in range(200)])
    assert hierarchy.closure(edges).count() == 200 * 201 // 2
    concepts = spark.createDataFrame([(i,) for i in range(201)], "concept_id int")
    leaves = hierarchy.leaves_under(concepts, edges)
    assert {r.ancestor for r in leaves.collect()} == set(range(1, 201)) and leaves.select("concept_id").distinct().collect()[0][0] == 0


def test_depths_of_a_longer_chain_with_shortcuts(spark):
    edges = edges_of(spark, [(i, i + 1) for i in range(40)] + [(i, 40) for i in range(0, 39, 3)] + [(5, 6), (99, 38)])
    concepts = spark.createDataFrame([(i,) for i in [*range(41), 99, 500]], "concept_id int")
    assert {r.concept_id: r.depth for r in hierarchy.depths(concepts, edges).collect()} == {i: 40 - i for i in range(41)} | {99: 3, 500: 0}


@pytest.mark.parametrize("rows", [[(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1), (5, 6)], [(i, i + 1) for i in range(9)] + [(9, 4)]])
def test_cycles_are_refused(spark, rows):
    for f in (hierarchy.closure, hierarchy.check_acyclic, lambda e: hierarchy.depths(spark.createDataFrame([(1,)], "concept_id int"), e)):
        with pytest.raises(hierarchy.CycleError):
            f(edges_of(spark, rows))


def test_no_edges(spark):
    none = edges_of(spark, [])
    concepts = spark.createDataFrame([(1,)], "concept_id int")
    assert hierarchy.closure(none).count() == 0 and hierarchy.depths(concepts, none).first().depth == 0
    hierarchy.check_acyclic(none)
