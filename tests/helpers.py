"""Small postings for golden rows."""

from jobdelta.schema import POSTING

_DEFAULTS = {f.name: None for f in POSTING.fields} | {"source": "greenhouse", "partial": False, "remote": False, "seniority": "mid"}


def posting(resource_id, key, title="Engineer", **fields):
    return {**_DEFAULTS, "resource_id": resource_id, "key": key, "title": title, "ordinal": 0, **fields}


def postings(spark, items):
    data = [tuple({**p, "ordinal": p["ordinal"] or n}[f.name] for f in POSTING.fields) for n, p in enumerate(items)]
    return spark.createDataFrame(data, POSTING)
