import random
import time

from quillspark.llm.lines import dedup_lines

from tests.llm.helpers import empty_documents, odd_documents


def brute(docs, window, long):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    first, gone = {}, set()
    for d in order:
        lines = [x for x in (docs[d][1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        for i in range(len(lines)):
            for n in ([window] if i + window <= len(lines) else []) + ([1] if len(lines[i]) >= long else []):
                run = (n, *lines[i : i + n])
                if first.setdefault(run, (d, i)) != (d, i):
                    gone |= {(d, p) for p in range(i, i + n)}
    out = []
    for d, (k, t) in enumerate(docs):
        kept, p = [], 0
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                if (d, p) not in gone:
                    kept.append(x)
                p += 1
            else:
                kept.append(x)
        out.append((str(k), p, sum(e == d for e, _ in gone), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {k}" for k in range(6)] + ["a long line " + "x" * 20 + str(k) for k in range(4)] + ["", " "]
    docs = [(rng.randrange(60), "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randrange(1, 12)))) for _ in range(90)]
    docs = [(k, t) for k, (_, t) in enumerate(docs)] + [(200, docs[3][1]), (201, None), (202, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    for window, long in ((3, 25), (2, 1000), (1, 5)):
        out = dedup_lines(df, window=window, long_chars=long).collect()
        assert sorted(((str(r["row"]["doc_id"]), r["lines"], r["removed_lines"], r["kept_text"]) for r in out), key=str) == brute(docs, window, long)


def test_plan_has_no_python(spark):
    plan = dedup_lines(odd_documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_input(spark):
    df = odd_documents(spark, [(None, "l1\nl2\nl3\nl4", None, None), (None, "l1\nl2\nl3\nl4", None, None), (9, "l1\nl2\nl3\nother", "en", "d")])
    out = dedup_lines(df, keep=df.columns, long_chars=10_000).collect()
    assert len(out) == 12
    rows = sorted(((r["row"]["doc_id"], r["lines"], r["removed_lines"], r["row"]["h"]) for r in out), key=str)
    assert [x for x in rows if x[1] == 4] == [(9, 4, 0, "own"), (None, 4, 3, "own"), (None, 4, 4, "own")]
    assert [r["kept_text"] for r in out if r["row"]["doc_id"] == 2] == [None]
    assert [x[2] for x in sorted(((r["row"]["doc_id"], r["lines"], r["removed_lines"]) for r in dedup_lines(df).collect()), key=str) if x[0] in (5, 6)] == [0, 1]
    assert dedup_lines(empty_documents(spark)).count() == 0


def test_a_megabyte_of_lines(spark):
    for line in ("x\n", "\n", "line of more than sixty characters, so that it is a window of its own\n", "a\nb\n"):
        began = time.time()
        t = line * (1_000_000 // len(line))
        (row,) = dedup_lines(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).collect()
        wanted = brute([(1, t)], 3, 60)[0]
        assert (row["lines"], row["removed_lines"], row["kept_text"]) == wanted[1:]
        assert time.time() - began < 60, line


def test_one_line_in_a_third_of_all_rows(spark):
    docs = [(k, f"{k} own\nshared by very many documents\nand so is this\nand this one\nend {k}" if k % 3 else f"only {k}") for k in range(6000)]
    out = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6))
    assert sorted(((str(r["row"]["doc_id"]), r["lines"], r["removed_lines"], r["kept_text"]) for r in out.collect()), key=str) == brute(docs, 3, 60)
