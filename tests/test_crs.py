"""Projected values against the worked examples that are published with the methods."""

import pytest
from pyspark.sql import functions as F

from spanlight.functions import crs


def dms(d, m, s):
    return d + m / 60 + s / 3600


# System or projection, longitude, latitude, easting, northing, tolerance.
EXAMPLES = [
    (lambda: crs.system(27700), 0.5, 50.5, 577274.99, 69740.50, 0.02),
    (lambda: crs.system(28992), 6.0, 53.0, 196105.283, 557057.739, 0.002),
    (lambda: crs.system(29873), dms(115, 48, 19.8196), dms(5, 23, 14.1129), 679245.73, 596562.78, 0.02),
    (lambda: crs.LambertConformalConic(dms(28, 23, 0), dms(30, 17, 0), dms(27, 50, 0), -99.0, 2_000_000 * 1200 / 3937, 0.0, crs.CLARKE_1866), -96.0, 28.5, 2963503.91 * 1200 / 3937, 254759.80 * 1200 / 3937, 0.02),
]


@pytest.mark.parametrize("projection, lon, lat, x, y, tolerance", EXAMPLES)
def test_published_examples(spark, projection, lon, lat, x, y, tolerance):
    p, at = projection(), spark.range(1).select(F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))
    got = at.select(*p.forward(F.col("lon"), F.col("lat"))).first()
    assert got[0] == pytest.approx(x, abs=tolerance) and got[1] == pytest.approx(y, abs=tolerance)
    back = spark.range(1).select(F.lit(x).alias("x"), F.lit(y).alias("y")).select(*p.inverse(F.col("x"), F.col("y"))).first()
    assert back[0] == pytest.approx(lon, abs=1e-6) and back[1] == pytest.approx(lat, abs=1e-6)


def test_codes():
    assert crs.code_of_keys(crs.geo_keys(32631)) == 32631 and crs.code_of_keys(crs.geo_keys(4326)) == 4326 and crs.code_of_keys({}) is None
    assert crs.system(4547).lon0 == 114 and crs.system(4526).lon0 == 114 and crs.system(25832).lon0 == 9
    with pytest.raises(ValueError):
        crs.system(1)


def test_descriptions(spark):
    for code in (4326, 32631, 28992, 5070):
        text = crs.well_known_text(code)
        assert spark.range(1).select(crs.code_of_text(F.lit(text))).first()[0] == code
    assert spark.range(1).select(crs.code_of_text(F.lit('PROJCS["x"]'))).first()[0] is None


def test_seven_parameters_by_their_published_example(spark):
    d = crs.Datum((0.0, 0.0, 4.5), (0.0, 0.0, 0.554), 0.219)
    row = spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip((3657660.66, 255768.55, 5201382.11), "xyz")])
    there = row.select(*[c.alias(n) for c, n in zip(d.to_wgs84(*map(F.col, "xyz")), "xyz")])
    assert all(abs(v - w) < 0.011 for v, w in zip(there.first(), (3657660.78, 255778.43, 5201387.75)))
    assert [round(v, 6) for v in there.select(*d.from_wgs84(*map(F.col, "xyz"))).first()] == [3657660.66, 255768.55, 5201382.11]


def test_a_grid_on_another_datum_meets_satellite_places(spark):
    # the worked example of the national grid: 651409.903, 313177.270 is 52 39 28.8282 N, 1 42 57.8663 E by satellite; seven parameters are good to some metres
    lon, lat = crs.moved(spark.createDataFrame([(651409.903, 313177.270)], "x double, y double"), 27700, 4326).first()
    assert abs(lon - (1 + 42 / 60 + 57.8663 / 3600)) * 67_500 < 5 and abs(lat - (52 + 39 / 60 + 28.8282 / 3600)) * 111_000 < 5
    assert abs(lon - (1 + 43 / 60 + 4.5177 / 3600)) * 67_500 > 50
