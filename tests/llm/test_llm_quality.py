import random

from brute import failures, measures

from tidegrid.llm import quality

RNG = random.Random(2)
WORDS = ["alpha", "beta", "Gamma", "dé", "ε", "#x|", "😀", "a"]
TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a b c d a b c", "a a a a a",
    "x\ty\x0bz\x0cw\rv\nu", "line\nline\n line\nline \n\nline", "a\x1cb c\x85d\xa0e", "#*$%&|<>[]",
    "same words here " * 40, "one two three\n" * 30, "word " * 3000,
    *[" ".join(RNG.choice(WORDS) for _ in range(n)) for n in (4, 20, 49, 50, 60, 300)],
    *["\n".join(" ".join(str(RNG.randrange(60)) for _ in range(9)) for _ in range(40)) for _ in range(6)],
]


def frame(spark, texts):
    rows = [(k // 2, t, "old", 7) for k, t in enumerate(texts)]  # ids repeat, names clash
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, failed_bits int")


def test_measures_and_bits_match_brute_force(spark):
    rows = quality.ledger(frame(spark, TEXTS + TEXTS)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", *quality.MEASURES, "failed_bits"}
    got = sorted((r.text or "\0", *[r[m] for m in quality.MEASURES], r.failed_bits) for r in rows)
    want = sorted((t or "\0", *measures(t), failures(measures(t))) for t in TEXTS + TEXTS)
    assert got == want


def test_policies_and_ablations(spark):
    rows = quality.ledger(frame(spark, TEXTS)).cache()
    bits = [failures(measures(t)) for t in TEXTS]
    kept = quality.keep_passing(rows, quality.POLICIES["v1"]).count()
    assert kept == sum(b & 7 == 0 for b in bits)
    table = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    for version, rules in quality.POLICIES.items():
        chosen = quality.mask(rules)
        for rule in rules:
            r, bit = table[version, rule], quality.mask([rule])
            assert r.documents == len(bits)
            assert r.rejected == sum(b & chosen != 0 for b in bits)
            assert r.failed_rule == sum(b & bit != 0 for b in bits)
            assert r.rejected_by_it_alone == sum(b & chosen == bit for b in bits)
            assert r.kept_without == sum(b & chosen in (0, bit) for b in bits)
    rows.unpersist()


def test_no_rows(spark):
    assert quality.ledger(frame(spark, [])).count() == 0


def test_plan_has_no_python_and_no_exchange(spark):
    plan = quality.ledger(frame(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame(
        [("a b c", "x", "y", "z", 1)], "text string, __text string, __words string, __lines string, n_words int"
    )
    row = quality.ledger(docs).first()
    assert (row.text, row["__text"], row["__words"], row["__lines"], row.n_words) == ("a b c", "x", "y", "z", 3)
