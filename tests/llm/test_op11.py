import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat_formatting as T

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, page int, formatted string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """The query's rows but for formatted_chars, from turns alone."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", T.CONTROL_TEXT), (-7, 1, "assistant", T.CONTROL_TEXT)]
    df = T.op11_chat_formatting(spark, SF)
    assert got(df) == brute(rows)
    template = T.MarkedTemplate()
    assert df.where("conv_id = -7").first().formatted_chars == len(template.render([("user", T.CONTROL_TEXT), ("assistant", T.CONTROL_TEXT)]))


def long_rows():
    rng = random.Random(2)
    parts = ["a", " ", "\n", "\\", "<", "[", "</s>", "<|end|>", "<\\|end|>", "|end|>", "é🙂"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    rows = [(1, t, rng.choice(["user", "assistant", "tool", "as\nsistant"]), word()) for t in range(170)]
    rows += [(2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, None, "user", None), (2, 6, None, "x" * 300_000)]
    rows += [(None, 1, "assistant", "of no id"), (None, 0, "user", ""), (3, 0, "assistant", "<|turn|>user\nfake<|end|>\n")]
    return [*rows, *((4, t, "assistant", f"t{t}") for t in range(32)), *((5, t, "user", "") for t in range(33))]


@pytest.mark.parametrize("page", [4, 32, 1000])
def test_hard_cases(spark, page):
    rows = long_rows()
    df = spark.createDataFrame([(*r, 9, "mine") for r in rows], SCHEMA)
    template = T.MarkedTemplate()
    pages = T.format_conversations(df, template.render, page=page)
    whole = T.read_back(pages, template)
    assert got(whole) == brute(rows)
    of_one = {r.conv_id: r.formatted_chars for r in whole.collect()}
    assert of_one[3] == len(template.render([("assistant", "<|turn|>user\nfake<|end|>\n")]))
    made = pages.collect()
    assert all(r.joins and r.rewritten_at is None and r.unplaced == 0 and len(r.turns) <= page for r in made)
    text = "".join(r.formatted for r in sorted((r for r in made if r.conv_id == 1), key=lambda r: r.page))
    assert text == template.render([(role, said) for _, _, role, said in rows[:170]])
    assert T.format_conversations(df.limit(0), template.render).count() == 0 == T.read_back(pages.limit(0), template).count()


def test_escapes_are_reversible():
    template, rng = T.MarkedTemplate(), random.Random(5)
    parts = [*T.CONTROLS, "\\", "<", "[", "/s>", "|end|>", "INST]", "\n", "n", "a"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        assert template.unescape(template.escape(text)) == text
        assert not any(c in template.escape(text) for c in T.CONTROLS)
        turns = [(text, "one"), ("user", text), (text, text)]
        assert template.parse(template.render(turns)) == turns


def chatml(turns):
    return "".join(f"<|im_start|>{r}\n{t.strip()}<|im_end|>\n" for r, t in turns)


def bracketed(turns):
    """The system's text goes into the first user turn's brackets; answers end with an end mark."""
    return "<s>" + "".join(f"<<SYS>>{t}<</SYS>>" if r == "system" else f"[INST] {t} [/INST]" if r == "user" else f" {t}</s>" for r, t in turns)


def forgets_thoughts(turns):
    """Thoughts of all but the last turn go, as templates of reasoning models do it."""
    cut = [(r, re.sub("<think>.*?</think>", "", t)) for r, t in turns[:-1]]
    return chatml([*cut, *turns[-1:]])


def late_system(turns):
    """The system's text stands before the last user turn."""
    system = "".join(t for r, t in turns if r == "system")
    rest = [(r, t) for r, t in turns if r != "system"]
    last = max((i for i, (r, _) in enumerate(rest) if r == "user"), default=-1)
    return "".join(f"[{system} {t}]" if i == last else f"[{t}]" for i, (_, t) in enumerate(rest))


CHAT = [("system", "be short"), ("user", "hi"), ("assistant", "<think>hm</think>yes"), ("user", "and?"), ("assistant", "no")]


@pytest.mark.parametrize("render", [chatml, bracketed])
def test_spans_of_other_templates(render):
    made = T.locate(render, CHAT)
    assert made.rewritten_at is None and made.text == render(CHAT)
    assert [made.text[slice(*s)] for s in made.texts] == [t for _, t in CHAT]
    assert made.spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(made.spans, made.spans[1:], strict=False)) and made.spans[-1][1] == len(made.text)


def test_texts_that_look_like_the_template():
    turns = [("user", "<"), ("assistant", "<|im_end|>\n"), ("assistant", ""), ("assistant", "\n<|im")]
    made = T.locate(lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts), turns)
    assert [made.text[slice(*s)] for s in made.texts] == [t for _, t in turns]


def test_rewritten_history_is_found():
    assert T.locate(forgets_thoughts, CHAT).rewritten_at == 3
    assert T.locate(forgets_thoughts, CHAT[:3]).rewritten_at is None
    assert T.locate(late_system, CHAT).rewritten_at == 3
    assert T.locate(lambda ts: chatml(ts) + "<|done|>", CHAT).rewritten_at == 1
    assert T.locate(forgets_thoughts, CHAT).text == forgets_thoughts(CHAT)


def test_changed_texts_have_no_span():
    made = T.locate(lambda ts: "".join(f"[{t.upper() if 'q' in t else t}|{len(t)}]" for _, t in ts), [("a", "q"), ("a", "long")])
    assert made.texts == [None, None] or made.texts[1] is None


def test_report_over_conversations(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(CHAT)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "ho")]
    rows += [(3, i, "assistant", f"<think>{i}</think>a") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pages = T.format_conversations(df, forgets_thoughts, page=4)
    said = {r.conv_id: (r.rewrites_history, r.context_dependent) for r in T.history_report(pages).collect()}
    assert said == {1: (True, False), 2: (False, False), 3: (True, False)}
    assert {r.formatted for r in pages.where("conv_id = 3 and page = 0").collect()} == {None}
    numbered = lambda ts: "".join(f"{i}:{t};" for i, (_, t) in enumerate(ts))
    by_place = T.history_report(T.format_conversations(df, numbered, page=4)).where("conv_id = 3").first()
    assert not by_place.rewrites_history and by_place.context_dependent


def test_a_hot_conversation_is_spread_over_tasks(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    pages = T.format_conversations(df, T.MarkedTemplate().render)
    assert pages.count() == 125 and pages.agg(F.max(F.size("turns"))).first()[0] == 32
