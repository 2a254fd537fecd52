import hashlib
import random
import re

from fairloom.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, items, n=10):
    w, hit, names = words(text), set(), set()
    for name, body in items:
        v = words(body)
        if not v:
            continue
        size = min(n, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                if name is not None:
                    names.add(str(name))
    return len(w), len(hit), ",".join(sorted(names)), len(names)


def check(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = d.match_items(df.select("doc_id", "text"), it, **options).collect()
    assert len(got) == len(docs)
    texts = dict((k, t) for k, t, _ in docs)
    for r in got:
        n, hit, names, _ = plain(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, ",".join(r.hit_items)) == (n, hit, names), r


def random_cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "d1"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]) if i > 4 else rng.choice([8, 9, 10, 12, 40]))) for i in range(8)]
    items = [x for x in items if len(words(x[1])) not in (1, 2)] + [(3, items[3][1]), (None, line(12)), (98, None), (99, " .,; ")]
    docs = [(i, f"{line(rng.randint(0, 40))}. {items[rng.randrange(8) % len(items)][1]}! {line(rng.randint(0, 30))}", 0) for i in range(40)]
    return docs + [(100, None, 0), (101, "", 0), (102, "...", 0), (103, line(30_000), 0)], items


def test_against_brute_force(spark):
    for seed in range(2):
        docs, items = random_cases(seed)
        check(spark, docs[:-1], items)
        check(spark, docs[:-1], items, block_words=40)


def test_report_and_empty_tables(spark):
    docs, items = random_cases(3)
    docs = docs[:20] + [(None, docs[0][1], 1), docs[1], docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination_report(df, it).collect()
    assert len(got) == 23
    for r in got:
        text = next(t for k, t, _ in docs if k == r.doc_id)
        n, hit, names, n_items = plain(text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, n_items, hit > 0)
        assert r.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
    assert d.contamination_report(df.limit(0), it).count() == 0
    assert {r.n_hit for r in d.contamination_report(df, it.limit(0)).collect()} == {0}


def test_spans_are_cut_out(spark):
    item = "One two three four five six seven eight nine ten eleven"
    text = f"Before, it stands – {item.upper()}! After it the rest remains as it is, with many more words than were cut away from here."
    df = spark.createDataFrame([(1, text, len(text)), (2, item, 9), (3, None, None), (4, "clean words", 11)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in d.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1].text.startswith("Before, it stands – ! After it the rest") and out[1].n_chars == len(out[1].text)
    assert out[4].text == "clean words" and out[3].text is None


def test_blocks_and_columns_that_clash(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([4, 9, 10, 25, 300]))) for i in range(60)]
    docs = [(i, f"{line(20)} {items[i % 60][1][: rng.randint(20, 900)]} {line(5)}. {items[(i * 7) % 60][1]}", 0) for i in range(80)]
    docs += [(i, docs[0][1], 0) for i in range(80, 120)]  # many copies of one text
    check(spark, docs, items, block_words=500)
    df = spark.createDataFrame([(i, t, "a", 1, 2, 3, 4, 5, 6, len(t)) for i, t, _ in docs], "doc_id long, text string, row_ string, n_hit int, n_words int, hits_ int, clean_ int, h1_ int, found_ int, n_chars int")
    it = spark.createDataFrame(items, "item_id long, text string")
    one, several = (sorted(tuple(r) for r in d.decontaminate(df, it, max_coverage=0.9, block_words=b).collect()) for b in (d.BLOCK_WORDS, 500))
    assert one == several and one and all(r[2:9] == ("a", 1, 2, 3, 4, 5, 6) and r[9] == len(r[1]) for r in one)


def test_a_large_benchmark_keeps_one_python_step(spark):
    items = spark.range(3_000).selectExpr("id as item_id", "array_join(transform(sequence(1, 100), i -> concat('x', hash(id, i))), ' ') as text")
    docs = items.where("item_id % 100 = 0").selectExpr("item_id as doc_id", "concat('before ', substring(text, 1, 500), ' behind') as text")
    found = d.match_items(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
    assert all(r.hit_items == [str(r.doc_id)] and r.n_hit >= 30 for r in found.collect())
