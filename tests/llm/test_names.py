"""The join of names against all pairs."""

import random
import zlib

import duckdb
import pytest

from skarn.llm import names


def osa(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def made(seed, n, letters="abcé😀", most=9):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, most))) for _ in range(n)]


def test_distances_against_the_table():
    a, b = made(1, 3000), made(2, 3000)
    a += ["b" * 64, "ab" * 40, "x" * 200, "ab" * 100, ""]
    b += ["b" * 63, "ab" * 39 + "ba", "x" * 198, "ba" + "ab" * 99, "ab"]
    want = [min(osa(x, y), 3) for x, y in zip(a, b, strict=True)]
    assert [min(d, 3) for d in names.distances(a, b, 2).tolist()] == want
    assert [names._band(x, y, 2) for x, y in zip(names.points(a), names.points(b), strict=True)] == want
    assert [min(d, 2) for d in names.distances(a, b, 1).tolist()] == [min(w, 2) for w in want]


def test_a_long_name_is_banded():
    t = "abcdefghij" * 2_000
    assert names.distances([t, t], [t[1:], t[5:]], 2).tolist() == [1, 3]


@pytest.mark.parametrize("cfg", [names.NameConfig(), names.NameConfig(most=1), names.NameConfig(pairs_per_name=0, least_pairs=3)])
def test_pairs_against_all_pairs(spark, cfg):
    a, b = [*made(3, 150), "", None, "abcé", "abcé"], [*made(4, 150), "", None, "bacé"]
    frame = lambda x: spark.createDataFrame([(n, 1, 2) for n in x], "name string, key int, id int")
    got = [tuple(r) for r in names.near_names(frame(a), frame(b), cfg).collect()]
    want = {(x, y, osa(x, y)) for x in a if x for y in b if y if osa(x, y) <= cfg.most}
    assert len(got) == len(set(got)) and set(got) == want


def test_query_against_all_pairs(spark, tmp_path):
    db = duckdb.connect()
    src = "/root/testdata/sf0.001"
    db.execute(f"copy (select client_id, name, 1 as \"left\" from '{src}/clients.parquet' union all select null, name, 1 from '{src}/vendors.parquet' where vendor_id < 9 union all select -5, '', 1) to '{tmp_path}/clients.parquet'")
    db.execute(f"copy (select vendor_id, name from '{src}/vendors.parquet' union all select null, 'Abc' union all select 9000, 'é') to '{tmp_path}/vendors.parquet'")
    clients = db.execute(f"select client_id, name from '{tmp_path}/clients.parquet'").fetchall()
    want = {}
    for v, name in db.execute(f"select vendor_id, name from '{tmp_path}/vendors.parquet'").fetchall():
        if not name:
            continue
        h = zlib.crc32(str(v).encode()) if v is not None else None
        if h is not None and h % 2 == 0 and len(name) >= 2:
            i = h % (len(name) - 1)
            name = name[:i] + name[i + 1] + name[i] + name[i + 2 :]
        for c, other in clients:
            if other and (d := osa(name, other)) <= 2:
                want.setdefault((v, d), []).append(c)
    rows = sorted((v, d, len(c), min((x for x in c if x is not None), default=None), sum(zlib.crc32(str(x).encode()) for x in c if x is not None) or None) for (v, d), c in want.items() if v is not None)
    got = [tuple(r) for r in names.op13_names(spark, str(tmp_path)).select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc").collect()]
    assert rows and sorted(r for r in got if r[0] is not None) == rows


def test_empty_tables(spark):
    none = spark.createDataFrame([], "name string")
    assert names.near_names(none, none).count() == 0
