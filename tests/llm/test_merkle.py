import hashlib
import re

from sorrel.llm import merkle


def plain_tree(text):
    leaf = re.compile(r"(?:[\x09-\x0D\x20]*[^\x09-\x0D\x20]+){1,8}|[\x09-\x0D\x20]+")
    return [[[hashlib.md5(w.encode()).hexdigest() for w in leaf.findall(p)] for p in s.split("\n")] for s in text.split("\n\n")]


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_root(tree):
    return sha([sha([sha(p) for p in s]) for s in tree])


def plain_like(a, b):
    ta, tb = plain_tree(a), plain_tree(b)
    if plain_root(ta) == plain_root(tb):
        return 1.0
    la, lb = ({w for s in t for p in s for w in p} for t in (ta, tb))
    return 2.0 * len(la & lb) / (len(la) + len(lb)) if la or lb else 0.0


def plain(rows):
    """Expected rows by the definition, ids unique."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        e = t[:len(t) - k] + n[:k]
        pa, pe = ([p for s in plain_tree(x) for p in s] for x in (t, e))
        first = next((j for j in range(max(len(pa), len(pe))) if pa[j:j + 1] != pe[j:j + 1]), None)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), plain_root(plain_tree(t)), plain_root(plain_tree(e)), plain_like(t, e), plain_like(t, n), first)
    return out


def test_matches_definition(spark):
    texts = [None, "", "one", "a b\n\n\nc  d\n", "\n", " \t", "é🙂 x " * 40, "w1 w2 w3 w4 w5 w6 w7 w8 w9\nsecond line\n\nnext section " * 4, "plain " * 9]
    rows = [(i * 37 % 1000 - 300, f"{texts[i % len(texts)] or ''} {i}" if i >= len(texts) else texts[i]) for i in range(90)] + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, n_chars int, fingerprint string").repartition(5)
    for size in (256, 4):
        got = {r[0]: tuple(r)[1:] for r in merkle.with_next(docs, rows_per_bucket=size).select("_id", "_text", "_next").collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        assert got == {a[0]: (a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1])}
    got = {r[0]: tuple(r)[1:] for r in merkle.fingerprints(docs).collect()}
    assert got == plain(rows)


def test_repeated_rows_single_row_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(9, "x y z")], "doc_id long, text string")
    out = merkle.fingerprints(docs).collect()
    assert len(out) == 4 and sorted(r["near_next"] for r in out) == [0.0, 0.0, 1.0, 1.0]
    assert merkle.fingerprints(docs.where("doc_id = 9")).first()["near_next"] == 1.0
    assert merkle.fingerprints(docs.limit(0)).count() == 0


def test_first_difference_locates_the_edit(spark):
    a = "intro\nkept line\n\nsection two\nold words here\nlast"
    df = spark.createDataFrame([(a, a.replace("old", "new")), (a, a), (a, a + "\nmore")], "a string, b string")
    trees = df.select(merkle.tree(df["a"]).alias("a"), merkle.tree(df["b"]).alias("b"))
    got = [r[0] for r in trees.select(merkle.first_difference(merkle.paragraphs(trees["a"]), merkle.paragraphs(trees["b"]))).collect()]
    assert got == [3, None, 5]


def test_each_text_is_cut_into_its_tree_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    plan = merkle.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3  # a text's own, the edited one's, and that of a range's first text
