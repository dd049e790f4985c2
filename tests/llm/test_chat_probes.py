"""What turns say under templates that trim, escape, rewrite, repeat or hide."""

import html

import pytest

from quarrykit.llm import chat

TURNS = [("user", "s"), ("assistant", " yes "), ("user", "</s>"), ("assistant", "s"), ("assistant", "a<b"), ("assistant", "")]
TEMPLATES = {
    "letters of its own": (lambda ts: "".join(f"<s>{r}: {t}</s>" for r, t in ts), [" yes ", "s", "a<b", ""]),
    "trims": (lambda ts: "".join(f"[{r}] {t.strip()} [/{r}]\n" for r, t in ts), ["yes", "s", "a<b", ""]),
    "escapes": (lambda ts: "".join(f"<{r}>{html.escape(t)}</{r}>" for r, t in ts) + ".", [" yes ", "s", "a&lt;b", ""]),
    "counts": (lambda ts: f"{len(ts)} turns\n" + "".join(f"{r}={t};" for r, t in ts), [" yes ", "s", "a<b", ""]),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_probes_find_what_is_said(name):
    render, want = TEMPLATES[name]
    text = render(TURNS)
    spans = [chat.said_span(text, TURNS, k, render) for k, (role, _) in enumerate(TURNS) if role == "assistant"]
    assert [text[s:e] for s, e in spans] == want


def test_turns_that_cannot_be_told(spark):
    twice = lambda ts: "".join(f"<{r}>{t}|{t}</{r}>" for r, t in ts)
    upper = lambda ts: "".join(f"{r}:{t.upper()}\n" for r, t in ts)
    last = lambda ts: "".join(f"{r}:{t if k == len(ts) - 1 else ''}\n" for k, (r, t) in enumerate(ts))
    assert chat.said_span(twice(TURNS), TURNS, 1, twice) is None and chat.said_span(upper(TURNS), TURNS, 1, upper) is None
    assert chat.said_span(last(TURNS), TURNS, 1, last) == (0, 0)
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(TURNS)], "conv_id bigint, turn bigint, role string, text string")
    (one,) = chat.format_chats(rows, render=twice).collect()
    assert one["unsure"] == [1, 3, 4, 5] and one["loss_starts"] == []
    (two,) = chat.format_chats(rows, render=TEMPLATES["trims"][0]).collect()
    assert [two["text"][s:e] for s, e in zip(two["loss_starts"], two["loss_ends"], strict=True)] == ["yes", "s", "a<b", ""] and two["unsure"] == []
