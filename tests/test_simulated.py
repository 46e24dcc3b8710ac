"""MD5 of many numbers against hashlib; simulated medians by counting against the histogram of all values, and its way out."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrablock.functions import md5
from terrablock.functions.md5 import Numbers
from terrablock.operators import resample


@pytest.mark.parametrize("chunk", [md5.CHUNK, 1])
def test_md5(monkeypatch, chunk):
    monkeypatch.setattr(md5, "CHUNK", chunk)
    numbers = np.array([0, 5, 10, 99, 100, 12345, 9999999, -7, 2**63 - 1, -(2**63)], np.int64)
    for prefix in (b"", b"1|2|", b"199|999|", b"-12345678901|-2147483648|"):
        texts = [hashlib.md5(prefix + str(x).encode()).hexdigest() for x in numbers]
        first, second = Numbers(numbers).hashed(prefix)
        assert first.tolist() == [int(t[:8], 16) for t in texts] and second.tolist() == [int(t[8:16], 16) for t in texts]
        assert (Numbers(numbers).hashed(prefix, second=False)[0] == first).all()
    with pytest.raises(ValueError):
        Numbers(numbers).hashed(b"x" * 40)


LOSS = {"rising": lambda d: 20 * F.log10(d), "falling": lambda d: -20 * F.log10(d), "flat": lambda d: d * 0 + 3.0}


@pytest.mark.parametrize(("share", "kind"), [(0.8, "rising"), (0.3, "rising"), (0.0, "rising"), (1.0, "rising"), (0.8, "falling"), (0.7, "flat")])
def test_same_as_ordering_all(spark, share, kind):
    """Each share puts the median among other values; a loss that falls leaves no edges."""
    cases = spark.createDataFrame([(k, k % 3, a, b) for k, (a, b) in enumerate([(1.0, 140.0), (0.5, 150.0), (5.0, 20.0), (1.0, 140.0)])], "case int, seed int, d_min double, d_max double")
    rows = spark.range(3001).withColumnRenamed("id", "i")
    args = (rows, 3001, cases, share, -110.0, 43.0, 10.0, LOSS[kind])
    got, want = ({r.case: (r.total, r.median) for r in f(*args).collect()} for f in (resample.simulated_medians, resample.ordered_medians))
    assert got.keys() == want.keys() == {0, 1, 2, 3}
    assert all(got[k][0] == 3001 and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_median_outside_the_edges(spark, monkeypatch):
    """Edges far too narrow: the cases whose median they miss are ordered whole."""
    monkeypatch.setattr(resample, "ERRORS", 0.0)
    monkeypatch.setattr(resample, "STEPS", 1 << 16)
    test_same_as_ordering_all(spark, 0.8, "rising")


def test_values_are_hashed_once(spark, monkeypatch):
    """The values of all cases must not be made in the rows of a join, twice: nothing is left for the histogram."""
    monkeypatch.setattr(resample, "ordered_medians", None)
    cases = spark.createDataFrame([(0, 7, 1.0, 140.0), (1, 8, 5.0, 20.0)], "case int, seed int, d_min double, d_max double")
    found = resample.simulated_medians(spark.range(2000).withColumnRenamed("id", "i"), 2000, cases, 0.8, -110.0, 43.0, 10.0, LOSS["rising"])
    assert [r.total for r in found.collect()] == [2000, 2000]


def test_few_or_no_numbers(spark):
    cases = spark.createDataFrame([(0, 7, 1.0, 140.0)], "case int, seed int, d_min double, d_max double")
    for n in (0, 1, 2):
        args = (spark.range(n).withColumnRenamed("id", "i"), n, cases, 0.8, -110.0, 43.0, 10.0, LOSS["rising"])
        got, want = ([(r.total, round(r.median, 9)) for r in f(*args).collect()] for f in (resample.simulated_medians, resample.ordered_medians))
        assert got == want and len(got) == min(n, 1)
