import random

import pytest
from pyspark.sql import functions as F

from jobdelta.operators.requests import interpret_requests

CASES = [
    ("iOS jobs in Austin making at least 150k a year with a maximum of 6 years of experience",
     {"keywords": ["ios"], "locations": ["austin"], "min_salary": 150_000, "max_experience_years": 6}),
    ("senior backend engineer roles in New York or remote paying $180,000+",
     {"keywords": ["backend"], "locations": ["new york", "remote"], "seniority": ["senior"], "min_salary": 180_000, "salary_currency": "USD"}),
    ("product designer jobs in London, no managers, £70k+",
     {"all_keywords": ["product", "designer"], "exclude_keywords": ["manager"], "locations": ["london"], "min_salary": 70_000, "salary_currency": "GBP"}),
    ("I have 4 years of experience and want golang roles in SF or NYC making over 160k",
     {"keywords": ["golang"], "locations": ["san francisco", "sf", "new york", "nyc"], "max_experience_years": 4, "min_salary": 160_000}),
    ("roles in albany new york", {"locations": ["albany"]}),
    ("node.js roles in kansas city", {"keywords": ["node.js"], "locations": ["kansas city"]}),
    ("what's open right now for staff data engineers in Denver?", {"keywords": ["data"], "locations": ["denver"], "seniority": ["staff"]}),
    ("python jobs under $200k in Berlin", {"keywords": ["python"], "locations": ["berlin"], "notes": 1}),
    ("remote machine learning engineer jobs, 3-5 years experience", {"all_keywords": ["machine", "learning"], "remote_only": True, "max_experience_years": 5}),
    ("entry level react developer remote $45/hr", {"keywords": ["react"], "seniority": ["entry"], "remote_only": True, "min_salary": 93_600, "salary_currency": "USD"}),
    ("jobs in the Greater Seattle area", {"locations": ["seattle", "bellevue", "redmond", "kirkland", "bothell", "tacoma"]}),
    ("", {}),
]
EMPTY = {"keywords": [], "all_keywords": [], "exclude_keywords": [], "locations": [], "seniority": [], "remote_only": False,
         "min_salary": None, "salary_currency": None, "max_experience_years": None, "notes": 0}


def test_golden_requests(rows):
    got = interpret_requests(rows("id int, q string", [(n, q) for n, (q, _) in enumerate(CASES)]), "q").withColumn("notes", F.size("notes"))
    by_id = {r.id: {k: r[k] for k in EMPTY} for r in got.collect()}
    for n, (q, want) in enumerate(CASES):
        assert by_id[n] == {**EMPTY, **want}, q


@pytest.mark.parametrize("seed", [1, 2])
def test_any_text_is_read(rows, seed):
    r = random.Random(seed)
    bits = ["in", "or", "$", "5", "years", "k", "|", "\\", "(", "é", "no", "remote", "100,000", "/", "~", " ", "$1", "senior", "...", "under", ","]
    texts = ["".join(r.choice(bits) + r.choice([" ", ""]) for _ in range(r.randrange(25))) for _ in range(150)] + [None]
    assert interpret_requests(rows("q string", [(t,) for t in texts]), "q").count() == len(texts)
    assert len(interpret_requests(rows("q string", [(t,) for t in texts]), "q").collect()) == len(texts)
