"""The swept market against plain loops over days."""

import datetime as dt
import json
import random
import statistics
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from chronolith.operators import market

SCHEMA = "episode_number int, opened_on date, closed_on date, positions_count int, employer string, is_agency boolean, is_public_direct boolean, is_entry_accessible boolean, is_apprenticeship boolean, canton string, role string"
START, END = dt.date(2024, 1, 10), dt.date(2024, 2, 20)


def episodes(n=250, seed=3):
    chance = random.Random(seed)
    flag = lambda: chance.choice([True, False, None])
    rows = []
    for _ in range(n):
        a = dt.date(2023, 12, 1) + dt.timedelta(days=chance.randint(0, 100))
        z = chance.choice([None, a, a - dt.timedelta(days=2), *(a + dt.timedelta(days=chance.randint(1, 40)) for _ in range(5))])
        rows.append((chance.randint(1, 3), a, z, chance.choice([None, 1, 5]), chance.choice([None, "", "x", "y", "z"]), flag(), flag(), flag(), flag(), chance.choice([None, "BE", "ZH"]), chance.choice(["a", "b"])))
    return rows + rows[:20]


def share(part, whole):
    return float((Decimal(part) / Decimal(whole)).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)) if whole else None


def expected(rows, level):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[d] for d in level), []).append(r)
    for values, own in groups.items():
        for k in range((END - START).days + 1):
            day = START + dt.timedelta(days=k)
            active = [r for r in own if r["opened_on"] <= day and (r["closed_on"] is None or r["closed_on"] > day)]
            count = lambda f: sum(1 for r in active if r[f])  # noqa: E731, B023
            known = [r for r in active if r["is_entry_accessible"] is not None]
            yield {
                "level": ",".join(level), "state_date": day, **dict(zip(level, values, strict=True)), "active_unique_vacancies": len(active), "estimated_positions": sum(r["positions_count"] or 0 for r in active), "positions_known": sum(r["positions_count"] is not None for r in active),
                "new_vacancies": sum(r["opened_on"] == day and r["episode_number"] == 1 for r in own), "reappeared_vacancies": sum(r["opened_on"] == day and r["episode_number"] > 1 for r in own), "disappeared_vacancies": sum(r["closed_on"] == day for r in own),
                "median_days_online": statistics.median([(day - r["opened_on"]).days for r in active]) if active else None, "unique_employers": len({r["employer"] for r in active if r["employer"]}), "unique_agencies": len({r["employer"] for r in active if r["employer"] and r["is_agency"]}), "active_postings": len(active),
                "public_direct_share": share(count("is_public_direct"), len(active)), "agency_share": share(count("is_agency"), len(active)), "apprenticeship_share": share(count("is_apprenticeship"), len(active)), "repost_rate": share(sum(r["episode_number"] > 1 for r in active), len(active)), "entry_accessible_share": share(count("is_entry_accessible"), len(known)),
            }


def plain(row):
    return json.dumps({k: v for k, v in row.items() if v is not None}, sort_keys=True, default=str)


def test_daily_state_equals_plain_loops(spark):
    rows = episodes()
    frame = spark.createDataFrame(rows, SCHEMA)
    levels = [[], ["canton"], ["canton", "role"]]
    found = market.daily_state(frame, levels, (str(START), str(END)), frame)
    ratios = [c for c in found.columns if c.endswith(("share", "rate"))]
    got = [r.asDict() for r in found.withColumns({c: F.col(c).cast("double") for c in ratios}).collect()]
    want = [row for level in levels for row in expected(rows, level)]
    want = [w | ({"median_days_online": float(w["median_days_online"])} if w["median_days_online"] is not None else {}) for w in want]
    assert sorted(map(plain, got)) == sorted(map(plain, want))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert market.daily_state(empty, [[], ["canton"]], (str(START), str(END))).count() == 0


def test_intervals_that_touch_or_repeat_are_one(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("k", day(1), day(5)), ("k", day(1), day(5)), ("k", day(5), day(6)), ("k", day(2), day(3)), ("k", day(8), day(9)), (None, day(1), day(2))]
    got = market.merged_intervals(spark.createDataFrame(rows, "key string, opened_on date, closed_on date"), ["key"]).collect()
    assert {(r.key, r.opened_on.day, r.closed_on.day) for r in got} == {("k", 1, 6), ("k", 8, 9), (None, 1, 2)}
