"""Chat formatting, the divergence audit and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest

from quern.llm import chat, divergence, merkle, template
from quern.llm.template import Template, TemplateError

EXTRA = ", ".join(f"`{c}` string" for c in ("part", "k", "h", "first", "last", "n", "leaf", "tree", "other", "term", "docs", "place", "value"))


def wide(rows):
    return [(*r, *["x"] * 13) for r in rows]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- templates


def test_templates_fold_constants_and_render():
    t = Template("{# c #}{% set e = '!' %}{%- for m in messages -%}{% if 1 == 2 %}dead{% elif m.role == 'a' %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% else %}[{{ m['role'] | upper }} {{ loop.index0 + 1 }}]{{ ('x' ~ 'y') if not false else 'z' }}{{ m.none }}{% endif %}{% if loop.last %}{{ e }}{% endif %}{% endfor %}{{ 'end' ~ 3 }}")
    assert "dead" not in repr(t.tree) and t.tree[-1] == ("text", "end3") and t.streams
    text, spans = t.render([{"role": "u", "text": "hi"}, {"role": "a", "text": " yo "}])
    assert text == "[U 1]xyyo!end3" and [text[a:b] for a, b in spans] == ["yo"]
    assert template.fold(("binary", "and", ("constant", False), ("name", "x")), {}) == ("constant", False)
    assert Template("{{ 'a' in b and not c or d[1] }}").render([], b="cat", c=None, d=[5, 6])[0] == "true"
    assert Template("{{ '}}' }}|{{ \"it's\" }}|{{ n - -2 }}").render([], n=1)[0] == "}}|it's|3"
    assert not Template("{{ messages | length }}").streams


@pytest.mark.parametrize("bad", ["{{ a.__class__ }}", "{{ _a }}", "{{ a() }}", "{% if x %}", "{{ 'a' * 9 }}", "{{ 'a", "{% bad %}", "{{ a | nofilter }}", "{{ a b }}", "{{ }}", "{{ 'a' + 'b' }}"])
def test_templates_refuse(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_values_are_no_objects():
    with pytest.raises(TemplateError):
        Template("{{ a.upper }}").render([], a="text")


def test_turn_by_turn_is_the_same_as_at_once():
    t = Template("{% set b = '<' %}{{ b }}{% for m in messages %}{% if loop.first %}F{% endif %}{{ b }}{% generation %}{{ m.text }}{% endgeneration %}{{ loop.index }}{% if loop.last %}L{% endif %}{% endfor %}{{ b }}")
    messages = [{"role": "u", "text": x} for x in ("one", "", "three")]
    out = []
    names = t.begin({}, out)
    for i, m in enumerate(messages):
        t.turn(names, m, i, i == 2, out)
    t.finish(names, out)
    assert template.joined(out) == t.render(messages)


def test_escaping_is_reversible():
    rng = random.Random(7)
    bits = ["<", ">", "s>", "/s>", "<s>", "</s>", "[INST]", "[/INST]", "[", "]", "INST]", "/", "\\", "\\\\", "x", "\n", "é"]
    for _ in range(4000):
        x = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        hidden = chat.escape(x)
        assert chat.unescape(hidden) == x and not any(c in hidden for c in chat.CONTROLS)
        assert chat.unline(chat.line(x)) == x and "\n" not in chat.line(x)
    assert chat.escape("plain \\ text < [x]") == "plain \\ text < [x]"


# --- conversations


def expected(rows):
    """By the rules of the contract, from the rows alone."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        out[conv] = (len(turns), sha(whole), len(loss), sha(loss))
    return out


def test_chat_on_a_hot_conversation_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "tool\nname"]), rng.choice(["hello", "</s>[INST]", "", "wörld 日本 " * 20, "\\</s>\\"])) for i in range(3000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"c{c} t{t}") for c in range(2, 300) for t in range(c % 5 + 1)]
    rows += [(500, None, None, None), (500, 0, "assistant", None), (500, 0, "assistant", "[/INST]"), (500, 0, "assistant", "[/INST]"), (None, 1, "user", "x"), (None, 2, "assistant", "long " * 50000), (501, 1, "", "[INST]\n")]
    df = spark.createDataFrame(wide(rows), "conv_id long, turn long, role string, text string, " + EXTRA).repartition(5)
    segments = chat.formatted(df, segment=2000)
    assert max(r["n"] for r in segments.collect()) < 300 and segments.where("conv_id = 1").count() > 20
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.read_back(segments).collect()}
    assert {k: v[:4] for k, v in got.items()} == expected(rows)
    # segments make up what the template renders at once
    for conv in (1, 7, 500, None):
        turns = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        parts = sorted((r["at"], r["text"]) for r in segments.where(segments.conv_id.eqNullSafe(conv)).collect())
        own = "".join(t for _, t in parts)
        assert len(own) == got[conv][4]
        assert own == chat.compiled().render([{"role": r, "text": x} for *_, r, x in turns])[0]


def test_chat_on_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(df)).collect() == []
    assert [r["conv_id"] for r in chat.read_back(chat.formatted(chat.with_trial(df))).collect()] == [-7]


# --- divergence


def audited(rows, least, most):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            counts[s].update({t: c[t] for t in kept if t in c})
        everything = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 5), n + 5 * len(kept))) for t in kept}

        q = shares(everything)
        p = {s: shares(c) for s, c in counts.items()}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, cut in (("pair", pairs, None), ("term", terms, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:cut])]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "STRIPE", 2)
    rng = random.Random(1)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "éñxyz"] + ["Ünïcode", "ABC", "zz\x00q", "a1b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice([None, "", *[f"s{k}" for k in range(36)]])) for i in range(700)]
    rows += [(1000, None, "en", "s1"), (1001, "", "xx", "only"), (1002, "alone alone", "yy", "a"), (1003, "rare", "yy", "b"), (None, "wordé " * 40000, "en", "hot"), (5, "waé waé", "en", "hot")]
    df = spark.createDataFrame(wide(rows), "doc_id long, text string, lang string, source string, " + EXTRA)
    assert sorted(map(tuple, divergence.audit(df, 6, 4).collect())) == audited(rows, 6, 4)


def test_divergence_sends_on_what_it_cannot_hold(spark, monkeypatch):
    rows = [(i, f"common word{i} other{i % 3}", "en", f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    got = divergence.audit(df, 2, 9)
    assert sorted(map(tuple, got.collect())) == audited(rows, 2, 9)
    monkeypatch.setattr(divergence, "FEW", 0)  # the shuffled joins
    assert sorted(map(tuple, divergence.audit(df, 2, 9).collect())) == audited(rows, 2, 9)


def test_divergence_shares_are_exact():
    import numpy as np

    for n, total in ((5, 7), (10**12, 10**12 + 1), (3, 8 * 10**13), (8 * 10**13 - 1, 8 * 10**13)):
        assert int(divergence._shares(np.array([n]), total)[0]) == 1 + floor(Fraction(10**9 * n, total))


def test_divergence_on_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


# --- Merkle


def h(nodes):
    return sha("".join(nodes))


def tree_of(leaves):
    """Levels from the leaves to the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 3 * 3
        out.append((nodes[run:at], nodes[at + 1 : run + 3]))
        at //= 3
    return out


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def manifested(rows):
    by = defaultdict(list)
    for r in rows:  # doc_id, source, lang, n_chars, text
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree_of([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for k, (*_, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = siblings_of(trees[s], k) + siblings_of(top, i)
            dealt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf_of((*r[:4], r[4] if r[4] is None else r[4].replace("\n", ""))) if dealt else own
            for left, right in way:
                fold = h([*left, fold, *right])
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h([x for a, b in way for x in a + b]), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n_sources, n_leaves", [(1, 1), (1, 4), (2, 82), (90, 1), (100, 3), (3, 300)])
def test_manifest_equals_brute_force(spark, n_sources, n_leaves):
    rows = [(i * 1000 + s, f"s{s:03}", "en", 5, ("a\nb", "ab", "", None)[(i + s) % 4]) for s in range(n_sources) for i in range(n_leaves)]
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == manifested(rows)


def test_manifest_on_odd_rows(spark):
    rows = [(1, "s", "en", 3, "a\nb")] * 2 + [(None, "s", None, None, None), (None, None, None, None, "x\n"), (2, "", "é", 0, ""), (2, None, "en", 1, "日\n本"), (-4, "ß", "de", None, "y\n" * 90000), (3, "s", "en", 2, "z")]
    rows += [(10 + i, "hot", "en", i, f"t\n{i}") for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(wide(rows), COLUMNS + ", " + EXTRA).repartition(6)).collect()
    assert sorted(map(tuple, got), key=repr) == manifested(rows)
    assert {r["verified"] for r in got} == {True, False} and len({r["root"] for r in got}) == 1


def test_manifest_on_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).collect() == []
