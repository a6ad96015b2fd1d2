"""The pipeline's stages against brute force on odd rows."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
COMMON = "Subscribe to our Newsletter today"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        lines = [prose(rng, 30), "", "  " + prose(rng, 30)]
        if i % 2 == 0:
            lines.insert(rng.randrange(4), " " * (i % 3) + (COMMON.upper() if i % 4 else COMMON) + "\t")
        out.append((i, "\n".join(lines), "en", [None, "a"][i < 55], 1, "x"))
    # Left with 49 words, not enough; and the same without an id.
    out += [(i, f"{COMMON}\n{prose(rng, 49)}", "en", "a", 1, "x") for i in (60, None)]
    out += [(61, None, "en", "a", 1, "x"), (62, "", None, None, 1, "x"), (None, f"{COMMON}\n{prose(rng, 60)}", "en", "a", 1, "x"), (63, f"{COMMON}\n{prose(rng, 60)}", "en", "other host", 1, "x"), out[4]]
    return out


def plain(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def after_quality(rows):
    """Brute force of the quality rules on these rows: COMMON is the only line above the limit, on host a only."""
    out = []
    for i, text, lang, source, n, kept in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if source != "a" or x.strip().lower() != COMMON.lower()]
        if len(" ".join(left).split()) >= 50:
            out.append((i, "\n".join(left), lang, source, n if left == lines else len("\n".join(left)), kept))
    return out


def test_quality_rules_remove_boilerplate(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.columns == docs.columns
    want = after_quality(rows)
    assert plain(got.collect()) == plain(want)
    assert 0 < len(want) < len(rows) and sum(COMMON.lower() in r[1].lower() for r in want if r[3] == "a") == 0


def test_quality_rules_on_no_rows(spark):
    assert corpus_pipeline.quality_rules(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_exact_and_near_stages(spark, rows):
    """Repeated rows, null ids, ids with two texts and clashing columns: one row of each group stays."""
    text = prose(random.Random(9), 80)
    near = text + " and more"
    data = [
        (1, text, "en", "a", 1, "x"), (2, text, "de", "a", 1, "y"), (2, text, "de", "a", 1, "y"), (None, text, "en", None, 1, "x"), (3, near, "en", "a", 1, "x"), (3, prose(random.Random(1), 60), "en", "a", 1, "x"),
        (4, None, "en", "a", 1, "x"), (5, "", "en", "a", 1, "x"), (None, near.upper(), "en", "a", 1, "x"), (None, prose(random.Random(2), 60), None, "a", 1, "x"),
    ]
    docs = spark.createDataFrame(data, SCHEMA).withColumnRenamed("lang", "_gone_id")
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    assert plain(exact.collect()) == plain([data[i] for i in (1, 4, 5, 7, 8, 9)])
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert plain(got.collect()) == plain([data[i] for i in (0, 5, 6, 7, 9)])
    assert plain(corpus_pipeline.drop_near_copies(spark, exact, "").collect()) == plain([data[i] for i in (1, 5, 7, 9)])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == corpus_pipeline.drop_exact_copies(spark, docs.limit(0), "").count() == 0


def test_whole_pipeline(spark, rows, tmp_path):
    """run() against the stages' brute force one after the other."""
    import hashlib

    import sentencepiece

    from rivulet.llm import mixing
    from rivulet.llm.queries import vocabulary

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    kept = after_quality(rows)
    by_text = {}
    for r in kept:
        by_text[r[1]] = max(by_text.get(r[1], r), r, key=lambda x: -1 if x[0] is None else x[0])
    unique = list(by_text.values())
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix_plan(spark.createDataFrame(unique, SCHEMA)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = []
    for r in unique:
        ids = sp.encode(r[1], add_bos=True, add_eos=True)
        want += [(r[0], len(ids), ids, hashlib.sha256(sp.decode(ids).encode()).hexdigest())] * copies[r[0], len(r[1].split())]
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert plain(found.collect()) == plain(want) and len(want) > 40
