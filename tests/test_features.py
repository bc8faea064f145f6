"""Feature collections read over many splits against the json module."""

import json
import random

import pytest
from pyspark.sql import types as T

from vigie.sources import scan_geojson

from .test_quoted import splits_of

PROPERTIES = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])


def collection(rng, n):
    names = ["a", 'quote " and \\ backslash', "{brackets} ] [", "é\n", "", "type\": \"Feature", None]
    features = []
    for k in range(n):
        size = 400 if k % 40 == 5 else rng.randint(1, 6)
        features.append({"type": "Feature", "id": k, "properties": {"k": k, "name": rng.choice(names), "other": {"x": [{"y": k}]}},
                         "geometry": rng.choice([None, {"type": "LineString", "coordinates": [[i, k] for i in range(size)]}])})
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:x"}}, "bbox": [0, 1, 2, 3], "features": features}


@pytest.mark.parametrize("layout", [{"indent": 1}, {"indent": None}, "lines"])
@pytest.mark.parametrize("size", [500, 1 << 20])
def test_splits(spark, tmpdir_path, layout, size):
    rng, want = random.Random(4), []
    for f in range(2):
        doc = collection(rng, 60)
        if layout == "lines":  # several features a line
            texts = [json.dumps(x) for x in doc["features"]]
            text = '{"type":"FeatureCollection","features":[\n' + ",\n".join(",".join(texts[i:i + 3]) for i in range(0, 60, 3)) + "]}\n"
        else:
            text = json.dumps(doc, ensure_ascii=False, **layout)
        with open(f"{tmpdir_path}/f{f}.geojson", "w", encoding="utf-8") as h:
            h.write(text)
        want += [(x["properties"]["k"], x["properties"]["name"], x["geometry"]) for x in doc["features"]]
    with splits_of(spark, size):
        df = scan_geojson(spark, tmpdir_path, PROPERTIES, split=True)
        got = [(r["k"], r["name"], None if r["geometry"] is None else json.loads(r["geometry"])) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_collection(spark, tmpdir_path):
    with open(f"{tmpdir_path}/none.geojson", "w") as h:
        h.write('{"type": "FeatureCollection",\n "features": []}\n')
    assert scan_geojson(spark, tmpdir_path, PROPERTIES, split=True).count() == 0
