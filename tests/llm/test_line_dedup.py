import random

from corpora import documents, edges, empty

from siltstone.llm import line_dedup


def trimmed(line: str) -> str:
    return line.translate({13: " ", 9: " "}).strip(" ")


def brute(rows: list[tuple]) -> dict[int, list[bool]]:
    """doc_id -> whether each line stays; doc_ids are distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        out[doc_id] = []
        for line in [] if text is None else text.split("\n"):
            x = trimmed(line)
            out[doc_id].append(not x or x not in seen)
            seen.add(x)
    return out


def runs(keep: list[bool]) -> str:
    out, at = [0], True
    for k in keep:
        if k != at:
            out.append(0)
            at = k
        out[-1] += 1
    return ",".join(map(str, out))


def made(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for i in range(120):
        lines = [rng.choice(["", " hot\t", "hot", f"line {rng.randrange(40)}", f"own {i} {rng.randrange(1000)}"]) for _ in range(rng.randrange(0, 30))]
        rows.append((i * 3, "\n".join(lines)))
    return [*rows, (1, None), (2, "")]


def test_bitmaps_and_texts_equal_brute_force(spark):
    rows = made(5)
    want = brute(rows)
    got = {r.doc_id: r for r in line_dedup.line_bitmaps(documents(spark, rows)).collect()}
    assert {i: (r.n_lines, r.n_dropped, r.keep_runs) for i, r in got.items()} == {i: (len(k), k.count(False), runs(k)) for i, k in want.items()}

    texts = {}
    for doc_id, text in rows:
        if text is None or all(want[doc_id]):
            texts[doc_id] = text
        else:
            lines = [x for x, k in zip(text.split("\n"), want[doc_id]) if k]
            if any(trimmed(x) for x in lines):
                texts[doc_id] = "\n".join(lines)
    left = line_dedup.drop_repeated_lines(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns
    found = left.collect()
    assert {r.doc_id: r.text for r in found} == texts
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)


def test_a_line_that_fills_many_partitions_has_one_first_place(spark):
    rows = [(i, "everywhere\nown %d" % i) for i in range(2000)]
    found = line_dedup.line_bitmaps(documents(spark, rows, 8)).where("n_dropped = 0").collect()
    assert [r.doc_id for r in found] == [0]


def test_edges(spark):
    d = edges(spark)
    found = line_dedup.line_bitmaps(d).collect()
    assert len(found) == d.where("doc_id is not null").count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.keep_runs))
    assert by[1] == [(1, 0, "1")] * 2 and by[2] == [(1, 1, "0,1")]
    assert by[3] == [(1, 0, "1")] and by[4] == [(0, 0, "0")] and by[5] == [(3, 0, "3")] and by[9] == [(50, 49, "1,49")]
    left = line_dedup.drop_repeated_lines(d)
    ids = [r.doc_id for r in left.collect()]
    assert 2 not in ids and 7 not in ids and ids.count(1) == 2 and ids.count(None) == 2 and {3, 4, 5} <= set(ids)
    assert line_dedup.line_bitmaps(empty(spark)).collect() == [] and line_dedup.drop_repeated_lines(empty(spark)).collect() == []


def test_a_long_text_takes_linear_time(spark):
    import time

    text = "\n".join(f"line {i % 60_000}" for i in range(120_000))
    began = time.time()
    (row,) = line_dedup.drop_repeated_lines(documents(spark, [(1, text)])).collect()
    assert row.text.count("\n") == 59_999 and time.time() - began < 60
