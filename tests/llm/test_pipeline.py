"""The pipeline against plain versions of its stages, and on tables without rows or with odd ones."""

import hashlib
import itertools
import re

import duckdb

import corpus_pipeline
from folioscope.llm import decontam, quality_rules, sp_codec, suffix_dedup
from tests.llm.test_corpus_ops import repeats_of, sets_of

SF = "/root/testdata/sf0.001"


def cleaned(text):
    """The lines of a text that no rule fails, by plain code."""

    def fails(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        n, low, open_ = len(w), x.lower(), not re.search(quality_rules.END, x)
        names = n >= 2 and all(v[0].isupper() or v[0].isdecimal() or v[0] in "«»‹›←→" for v in w)
        return n > 0 and (
            sum(x.count(c) for c in "#*$%&<>") >= 0.5 * n
            or x.count("|") >= 0.25 * n
            or (x.count("!") if not any(c.islower() for c in x) else 0) >= 0.8 * n
            or (n <= 30 and any(p in low for p in quality_rules.BOILERPLATE))
            or (n >= 12 and len(set(x.split(" "))) <= 0.25 * n)
            or (open_ and n <= 10 and ((n <= 4 and len(x) <= 40) or names))
            or (open_ and n <= 30 and len(re.findall(quality_rules.BARE, x, re.A)) >= max(3, 0.5 * n))
        )

    return "\n".join(x for x in text.split("\n") if not fails(x))


def plain(sf):
    """doc_id -> the text that is left, by rules of each stage alone."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    kept = {k for k, ok in con.execute(f"select doc_id, kept from ({quality_rules.ORACLE_SQL})").fetchall() if ok}
    texts = {k: cleaned(t) for k, t in con.execute("select doc_id, text from documents order by doc_id").fetchall() if k in kept}
    digests = dict(con.execute(f"select doc_id, clean_sha256 from ({quality_rules.ORACLE_SQL})").fetchall())
    assert all(hashlib.sha256(t.encode()).hexdigest() == digests[k] for k, t in texts.items())
    # One document of each group of similar ones: the smallest id.
    ids = list(texts)
    sets = list(sets_of(texts.values()))
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(ids)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    texts = {k: texts[k] for n, k in enumerate(ids) if find(n) == n}
    # Passages of many words that repeat.
    data = {k: (t or "").encode() for k, t in texts.items()}
    for (k, b), gone in zip(data.items(), repeats_of(list(data.values()), suffix_dedup.PASSAGE), strict=True):
        left, at = b"", 0
        for covered, run in itertools.groupby(range(len(b)), lambda p: gone[p]):
            run = list(run)
            if covered and len(b[run[0] : run[-1] + 1].split()) > suffix_dedup.PASSAGE_WORDS:
                left, at = left + b[at : run[0]], run[-1] + 1
        texts[k] = (left + b[at:]).decode("utf-8", "ignore")
    # Benchmark items, in order, in windows of twice the longest item: without any search for candidates.
    items = [decontam.words_of(t) for (t,) in con.execute(f"select text from '{sf}/benchmark.parquet' where text is not null").fetchall()]
    step = max(map(len, items))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    def holds(words):
        for p in range(0, max(1, len(words)), step):
            seen = words[p : p + 2 * step]
            here = set(seen)
            for item in items:
                if sum(w in here for w in item) < 0.6 * len(item):
                    continue
                share = common(item, seen) / len(item)
                answer = item[-decontam.ANSWER_WORDS :]
                if share >= decontam.LCS_ALONE or (share >= decontam.LCS_WITH_ANSWER and common(answer, seen) >= decontam.ANSWER * len(answer)):
                    return True
        return False

    return {k: t for k, t in texts.items() if not holds(decontam.words_of(t))}


def test_run(spark):
    want = plain(SF)
    library = sp_codec.codec(sp_codec.public_model()).library
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and len(want) > 80
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, t in want.items():
        ids = library.encode(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))), k


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "sentencepiece"]


def test_run_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, columns with names that the stages use themselves."""
    words = " ".join(f"Word{k % 83} of line{k % 31}." for k in range(120))
    rows = [(1, None, "en", 0, 1, "k"), (2, "", "en", 0, 1, "k"), (None, words, None, None, 2, "k"), (None, words, None, None, 2, "k"), (4, words + " end.", "en", 5, 3, None), (5, "x " * 80, "en", 5, 3, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, key int, ref string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a benchmark item of some words"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(got) <= 1 and set(got) <= {4, None}
