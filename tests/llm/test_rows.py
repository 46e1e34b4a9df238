"""License scan, personal data, chat formatting and quality scores."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vernissage.llm import chat, licenses, pii, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_license_base_and_notices(wide_docs, no_docs):
    got = {r.doc_id: r for r in licenses.scan(wide_docs).collect()}
    for r in wide_docs.collect():
        words = WORD.findall(lower(r.text))
        at = [i for i in range(len(words) - 1) if words[i : i + 2] == ["mit", "license"]]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert g.base_labels == ("mit" if at else "") and 0 <= g.score <= 1
        assert g.labels == ("mit,mit-notice" if at else "")
    assert licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize(
    ("template", "text", "length"),
    [
        ("a [[b]] c", "a b c", 3), ("a [[b]] c", "a c", 2), ("a [[b]] c", "a b b c", 0), ("a {2} c", "a x y c", 4),
        ("a {2} c", "a x y z c", 0), ("a {2} c", "a c", 2), ("a [[b [[c]] d]] e", "a b d e", 4), ("[[a]] b", "b", 1),
        ("a [[b]] [[c]]", "a c", 2), ("a b", "a x b", 0), ("a {1} c [[d]]", "a c d", 3), ("a c", "a", 0),
    ],
)
def test_template_markup(template, text, length):
    automaton = licenses.compile_template(template)
    assert automaton.longest([w.encode() for w in text.split()], 0) == length


@pytest.mark.parametrize("template", ["[[a]]", "{2} a", "a [[b"])
def test_templates_that_cannot_be_matched_are_refused(template):
    with pytest.raises(ValueError):
        licenses.compile_template(template)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def personal_texts():
    card, iban = "4539 1488 0343 6467", "GB82 WEST 1234 5698 7654 32"
    rng = np.random.default_rng(3)
    parts = [
        "a@b.cd", "x.y%z+1@mail-1.example.com", "a@b.cd_e@f.gh", "@a.b", "a@b", "é@b.cd", "a@b.c..d", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1",
        "0000255.1.1.001", "12.34", card, card.replace(" ", "-"), card[:-1] + "8", "4539  1488 0343 6467", "1" * 16, "0" * 19, "0" * 20, "+1 (377) 555-0271",
        "+12", "+1 2 3", "+1234567 89012345678", "++44 20 7946 0958.", iban, iban[:-1] + "3", "card 3714 496353 98431", "\U0001f600", "é", " ", "\n", "-", ".", "+", "1", "visa",
    ]
    texts = ["".join(rng.choice(parts, size=rng.integers(1, 9))) for _ in range(400)] + [" ".join(parts), None, "", "7" * 50_000, "a" * 50_000 + "@", "1 " * 20_000]
    return texts


def test_personal_data(spark):
    texts = personal_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(frame).collect()}
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        base = plain_spans(text)
        assert got[n].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (text, base, got[n].spans)
        assert [s for s in got[n].spans.split(",") if s.split(":")[0] in PLAIN] == base
        assert (got[n].n_email, got[n].n_ip, got[n].n_card, got[n].n_phone) == tuple(sum(s.startswith(k) for s in base) for k in PLAIN)


def test_personal_data_of_further_kinds(spark, no_docs):
    rows = [(1, "my iban GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "amex card 371449635398431"), (4, "371449635398431")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:8:35", 2: "", 3: "shortcard:10:25", 4: ""}
    assert pii.report(no_docs).count() == 0


def test_account_numbers_end_before_the_words_after_them(spark):
    """The longest part up to a space that passes the checksum counts, whatever the pattern takes with it."""
    texts = {
        1: "pay BE68 5390 0754 7034 BIC GKCCBEBB", 2: "BE68 5390 0754 7034 GKCC BEBB XX", 3: "BE68539007547034 BIC", 4: "GB82 WEST 1234 5698 7654 32 EUR",
        5: "BE68 5390 0754 7035 BIC", 6: "BE68 5390 0754 7034BIC", 7: "é BE68 5390 0754 7034 and GB82 WEST 1234 5698 7654 32", 8: "BE68 5390", 9: None,
    }
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {
        1: "iban:4:23", 2: "iban:0:19", 3: "iban:0:16", 4: "iban:0:27", 5: "", 6: "", 7: "iban:2:21,iban:26:53", 8: "", 9: "",
    }


def test_personal_data_runs_without_python(docs):
    plan = pii.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s> there"), (1, 2, "assistant", "[INST] ok [/INST]"), (1, 3, "user", None),
    (2, 0, "assistant", "out of order"), (2, 0, "user", "a tie"), (3, 5, "tool <s>", "\\ \\\\ <\\s> [OUT]"), (4, None, None, ""),
    (None, 1, "user", "no id"), (5, 0, "user", "<" * 3), (5, 1, "assistant", " [/INST] </"), (5, 1, "assistant", " [/INST] </"), (6, 0, "user", "x" * 200_000),
]


def test_chat_round_trip(spark):
    many = [(50, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </s>") for i in range(400)]
    rows = TURNS + many
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first", F.lit(9)).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, g in got.items():
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: g.valid for c, g in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: False, 6: True, 50: True}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_escaped_text_holds_no_control_string():
    t = chat.DEFAULT
    for text in ("<s>", "<<SYS>><</SYS>>", "[[INST]]", "\\<s>", "<\\s>", "\\", "[/INST][/INST]", "<</s>"):
        assert t.unescape(t.escape(text)) == text
        assert not any(c in t.escape(text) for c in t.controls)


def test_a_template_with_unclear_marks_is_refused():
    with pytest.raises(ValueError):
        chat.Template("aba", {"user": chat.Turn("aba", "aba")}, ("aba",), {})


SMALL = quality.Settings(vocabulary=1 << 10, width=16, ranges=4, hidden=8, epochs=30)


def quality_rows(n):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)]
    good = [" ".join(rng.choice(words, 60)) for _ in range(n)]
    bad = [" ".join(f"{w}###" for w in rng.choice(words, 60)) for _ in range(n)]
    return [(i, t, 1) for i, t in enumerate(good)] + [(n + i, t, 0) for i, t in enumerate(bad)]


def test_quality_learns_and_keeps_columns(spark, wide_docs):
    rows = quality_rows(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows] + [(None, 1, 0), (10**9, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, settings=SMALL).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 60 < len(held) < 180
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got.values())
    scored = quality.classify(wide_docs, labels, settings=SMALL)
    assert scored.count() == wide_docs.count()
    assert set(wide_docs.columns) <= set(scored.columns)
    assert quality.accepted(wide_docs, labels, SMALL).columns == wide_docs.columns


def test_quality_scores_do_not_depend_on_held_out_labels(spark):
    rows = quality_rows(60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x, settings=SMALL).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_quality_without_labels_or_rows(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.classify(docs, none, settings=SMALL).collect()} == {0.5}
    assert quality.classify(no_docs, none, settings=SMALL).count() == 0
