from collections import Counter

from compare import assert_same

from lectern.llm import quality_rules as Q


def brute_repeats(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)})


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(Q.digest(Q.measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))), duck.sql(Q.ORACLE_SQL))


def test_edges(docs_of):
    text = " ".join(f"w{i % 11}" for i in range(40))
    prose = "This is a line of prose with words.\n" * 3 + " ".join(f"word{i}" for i in range(60)) + "."
    menu = "\n".join(["Home | News | Sport | More"] * 2 + [" ".join(f"word{i}" for i in range(5)) + "."])
    df = docs_of([(1, None), (2, ""), (3, " \n\t "), (4, text), (5, prose), (6, menu), (6, menu), (None, "a b")])
    got = {r.doc_id: r for r in Q.measure(df).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[4].n_repeat_words == brute_repeats(text) == 40 and got[4].base_failed
    assert got[5].n_dup_lines == 2 and got[5].kept and got[5].clean_text == prose
    assert got[6].n_lines_removed == 2 and Q.measure(df).count() == 8 and Q.measure(df.limit(0)).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = Q.measure(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_notices_in_four_languages(docs_of):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    lines = ["All Rights Reserved.", "Tous droits réservés.", "Nous lisons nos Conditions d'utilisation.", "Alle Rechte vorbehalten!", "Hier klicken, bitte.", "Todos los derechos reservados.", "Haga clic aquí."]
    df = docs_of([(i, f"{x}\n{prose}") for i, x in enumerate(lines)] + [(99, f"Alle Rechte hat der Mensch.\n{prose}")])
    got = {r.doc_id: r for r in Q.measure(df).collect()}
    assert all(got[i].n_lines_removed == 1 and got[i].clean_text == prose for i in range(len(lines))) and got[99].n_lines_removed == 0
