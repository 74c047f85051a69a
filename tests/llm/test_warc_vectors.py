import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from hazecast.llm import embeddings, warc

PAGE = "page_id long, url string, html string, record_type string"


def pages():
    rng = random.Random(1)
    big = "".join(rng.choices("abc é\r\n", k=300_000)) + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 20
    rows = [(i, f"http://x/{i}", "short", "r") for i in range(5)] + [(10, "u", big, "r"), (11, "u", big, "r"), (12, None, trap, "r"),
            (13, "a\r\nWARC-Type: revisit", trap, "r"), (14, "u", None, None), (15, "u", "", "r"), (None, "u", trap, "r"), (None, None, None, None),
            (None, "u", "lonely" * 300, "r"), (16, "u", "y" * 1000, "r"), (17, "u", "y" * 1000, "r"), (17, "u", "y" * 1000, "r"), (18, "u", "y" * 999, "r"),
            (19, "u", "y" * 999, "r"), (20, "u", "z" * warc.SEGMENT, "r"), (21, "u", "z" * (2 * warc.SEGMENT), "r"), (22, "u", "é" * warc.SEGMENT, "r")]
    return rows


def expected(rows):
    groups = defaultdict(list)
    for i, _, html, _ in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html, _ in rows:
        raw, ids = (html or "").encode(), [x for x in groups[html or ""] if x is not None]
        best = max(ids) if len(raw) >= 1000 and len(groups[html or ""]) > 1 and ids else None
        revisit = best is not None and i != best
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


def test_round_trip(spark):
    rows = pages()
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGE).repartition(3)).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(expected(rows), key=KEY)


def test_records_that_span_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_ARCHIVE", 2)
    rows = pages()
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGE).repartition(2)).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(expected(rows), key=KEY)


def test_chunks_hold_the_payload_and_stay_small(spark, tmp_path):
    rows = pages()
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, PAGE).coalesce(1), path)
    chunks = warc.read_chunks(spark, path).orderBy("record", "chunk").collect()
    assert max(r.n_bytes for r in chunks) <= warc.SEGMENT
    body = defaultdict(bytes)
    for r in chunks:
        body[r.record] += r.bytes
    stored = [v for v in body.values() if len(v) > warc.SEGMENT]
    assert sorted(hashlib.sha1(v).hexdigest() for v in stored) == sorted(d for _, n, d, kind, _ in expected(rows) if n > warc.SEGMENT and kind == "response")


def test_a_foreign_record_is_read_in_chunks():
    import io
    body = bytes(range(256)) * 1000
    raw = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    got = list(warc.parse_archive(io.BytesIO(raw)))
    assert b"".join(x[3] for x in got) == body and {x[2] for x in got} == {math.ceil(len(body) / warc.SEGMENT)}
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(raw[:-100])))


def test_a_changed_byte_is_noticed(spark, tmp_path):
    import gzip
    path = tmp_path / "a"
    warc.write_archives(spark.createDataFrame([(1, "u", "payload" * 400, "r")], PAGE), str(path))
    file = next(path.glob("part-*"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"payload", b"Payload", 1)))
    for crc in path.glob(".*.crc"):
        crc.write_bytes(b"")
    with pytest.raises(Exception, match="wrong payload|ChecksumException|EOF|CRC"):
        warc.read_records(spark, str(path)).collect()


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def vectors(n, d, groups, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(groups):  # copies with noise, near the threshold
        i = rng.integers(n)
        x[rng.integers(n)] = x[i] + rng.normal(size=d) * np.linalg.norm(x[i]) / math.sqrt(d) * rng.uniform(0, 0.4)
    return x


def brute(rows, threshold=0.95):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = embeddings.unit([rows[i][1], rows[j][1]])
                if a @ b >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                seen[j] = min(ids, default=None)
    for i, (v, _) in enumerate(rows):
        out.append((v, len(links[i]), seen[i], v == seen[i] if v is not None and seen[i] is not None else not links[i]))
    return out


@pytest.mark.parametrize("block,cells", [(1024, None), (7, 3), (16, 12)])
def test_vectors_equal_brute_force(spark, block, cells):
    x = vectors(220, 16, 90)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [float("inf")] + [1.0] * 15),
             (305, [None] + [1.0] * 15), (306, rows[0][1]), (None, rows[0][1]), (307, rows[0][1][:8]), (308, [2 * c for c in rows[1][1]]),
             (5, rows[5][1]), (6, rows[7][1]), (309, [1e30 * c for c in rows[2][1]])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got = embeddings.link_vectors(df, block=block, cells=cells, margin=0.33)  # the exact margin
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute(rows), key=KEY)


def test_recall_of_the_default_margin(spark):
    x = vectors(3000, 64, 1500, seed=2)
    got = embeddings.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = embeddings.unit(x)
    want = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in got.collect()}
    assert all(found[i] <= want[i] for i in range(len(x)))
    assert sum(found.values()) >= 0.99 * want.sum() > 100


def test_no_vectors(spark):
    assert embeddings.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
