"""Conversation repair, prefix tries and page texts against brute force, and on odd rows."""

import hashlib
import html as escapes
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelspark.llm import queries
from panelspark.llm.page_text import main_text, page_texts, smoothed, two_means
from panelspark.llm.prefix_trie import prefix_turns, rebuilt_prefixes, rebuilt_turns, shared_prefixes
from panelspark.llm.repair import damage, repair_report, repair_turns
from tests.conftest import TINY

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, key int, place string, path string, depth long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "q", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeats, foreign roles, a long conversation."""
    rng = random.Random(5)
    rows = [
        (None, 1, "user", "no id."),
        (None, None, None, None),
        (1, None, "user", "no turn."),
        (1, 1, "assistant", "same turn."),
        (1, 1, "assistant", "same turn, other text"),
        (1, 1, "assistant", "same turn."),
        (2, 3, None, "no role."),
        (2, 4, "user", None),
        (2, 5, "", ""),
        (3, 0, "tool", "x" * 100_000 + "."),
        (3, 9, "System", " \t\n"),
        (-4, 0, "user", "négatif é ."),
    ]
    rows += [(20, i, "ua"[i % 2] == "u" and "user" or "assistant", f"t{i % 97}.") for i in range(700)]
    roles = ["system", "user", "assistant", "user", "assistant", "tool"]
    for conv in range(5, 60):
        for turn in range(rng.randrange(0, 9)):
            text = rng.choice(["a.", "b.", "c", "", " ", f"{turn}!", f"{conv % 3} {turn}?"])
            rows.append((conv, turn, rng.choice(roles), text))
    return rows


# Repair ----------------------------------------------------------------------------------


def first_key(value):
    return (value is not None, value if value is not None else 0)


def damaged(rows):
    convs = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        shown = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(shown.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for turns in convs.values():
        turns.sort(key=lambda r: (first_key(r[0]), r[1].encode(), r[2].encode()))
    return convs


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        visible = VISIBLE.findall(text)
        if not visible:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("" if visible[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """Dynamic program over whole audits: (cost, audit, repaired) of every state, forwards."""
    steps = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserts(best):
        queue = list(best)
        while queue:
            state = queue.pop()
            cost, audit, kept = best[state]
            new = (cost + 5, audit + "I", [*kept, (steps[state], "")])
            to = after[state]
            if to not in best or new[:2] < best[to][:2]:
                best[to] = new
                queue.append(to)
        return best

    best = inserts({0: (0, "", [])})
    for (_, role, text), fault in zip(turns, faults, strict=True):
        found = {}

        def offer(state, cost, audit, kept, found=found):
            if state not in found or (cost, audit) < found[state][:2]:
                found[state] = (cost, audit, kept)

        for state, (cost, audit, kept) in best.items():
            offer(state, cost + 2, audit + "D", kept)
            if fault in ("b", "d"):
                continue
            extra = 5 if fault == "t" else 0
            if role[:1] == steps[state][0]:
                offer(after[state], cost + extra, audit + "K", [*kept, (role, text)])
            if state == 0 and role[:1] == "s":
                offer(1, cost + extra, audit + "K", [*kept, (role, text)])
            offer(after[state], cost + extra + 1, audit + "R", [*kept, (steps[state], text)])
        best = inserts(found)
    return min(best[s] for s in (0, 3) if s in best)


def by_edits(turns, faults):
    """Every edit sequence with up to two inserts in a row, tried one by one."""
    found = []

    def go(i, cost, audit, kept):
        initials = "".join(r[:1] or "?" for r, _ in kept)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", initials):
            found.append((cost, audit, kept))
        if not audit.endswith("II") and cost < 30:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*kept, (role, "")])
        if i < len(turns):
            _, role, text = turns[i]
            go(i + 1, cost + 2, audit + "D", kept)
            if faults[i] not in ("b", "d"):
                extra = 5 if faults[i] == "t" else 0
                go(i + 1, cost + extra, audit + "K", [*kept, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + extra + 1, audit + "R", [*kept, (new, text)])

    go(0, 0, "", [])
    return min(found)


def expected_report(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        faults = faults_of(turns)
        cost, audit, kept = cheapest(turns, faults)
        numbers = {t for t, *_ in turns if t is not None}
        initials = [r[:1] for _, r, _ in turns]
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def reported(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def read_rows(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_repair_of_the_table(spark):
    assert reported(queries.op11_structure_repair(spark, TINY)) == expected_report(read_rows(spark, TINY))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_repair_of_odd_rows_in_any_batches(spark, odd_rows, batch):
    rows = damage(table(spark, odd_rows))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        # A block of 300 characters makes most conversations spill.
        assert reported(repair_report(rows, block_bytes=300)) == expected_report(odd_rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_repair_tries_every_edit():
    rng = random.Random(3)
    for _ in range(60):
        turns = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", ""])) for i in range(rng.randrange(6))]
        faults = faults_of(turns)
        assert cheapest(turns, faults) == by_edits(turns, faults)


def test_repaired_turns_are_those_of_the_digest(spark, odd_rows):
    rows = damage(table(spark, odd_rows))
    repaired = defaultdict(list)
    for r in repair_turns(rows, block_bytes=300).orderBy("conv_id", "place").collect():
        repaired[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for conv, report in reported(repair_report(rows)).items():
        places = [p for p, _ in repaired[conv]]
        assert places == list(range(1, len(places) + 1))
        text = "\n".join(t for _, t in repaired[conv])
        assert hashlib.sha256(text.encode()).hexdigest() == report[-1]


def test_repair_without_rows(spark):
    empty = table(spark, []).limit(0)
    assert repair_report(damage(empty)).count() == 0
    assert repair_turns(empty).count() == 0


# Tries -----------------------------------------------------------------------------------


def own_turns(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((first_key(turn), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(rows):
    own = own_turns(rows)
    out = {}
    for conv, turns in own.items():
        if conv is None:
            out[conv] = turns
            continue
        h = zlib.crc32(str(conv).encode()) % 9
        # Remainders take the sign of the id.
        base = own.get(conv - (abs(conv) % 5) * (1 if conv >= 0 else -1), [])
        out[conv] = base[:h] + turns[h:]
    return out


def expected_trie(convs):
    members = defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    least = lambda node: min(members[node], key=first_key)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = own + sum(saved[c] for c in children[node])
        ends = sorted((c for c in members[node] if len(convs[c]) == len(node)), key=first_key)
        text = ",".join("null" if c is None else str(c) for c in ends)
        out.append(
            (
                least(node),
                len(node),
                least(node[:-1]) if node else None,
                len(members[node]),
                len(children[node]),
                leaves[node],
                saved[node],
                hashlib.sha256(text.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_of_the_table(spark):
    assert collected(queries.op13_prefix_trie(spark, TINY)) == expected_trie(rebuilt(read_rows(spark, TINY)))


def test_trie_of_odd_rows(spark, odd_rows):
    assert collected(rebuilt_prefixes(table(spark, odd_rows))) == expected_trie(rebuilt(odd_rows))
    assert collected(shared_prefixes(table(spark, odd_rows))) == expected_trie(own_turns(odd_rows))


def test_trie_of_copies_forks_and_nested_ends(spark):
    """Copies, ends inside other conversations, and forks at many depths on one path."""
    rng = random.Random(9)
    trunk = [("user", f"turn {i}") for i in range(14)]
    convs = {}
    for conv in range(1, 150):
        cut = rng.randrange(15)
        tail = [("assistant", f"{rng.randrange(3)}") for _ in range(rng.randrange(4))]
        convs[conv] = trunk[:cut] + tail
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    kept = {c: turns for c, turns in convs.items() if turns}
    assert collected(shared_prefixes(table(spark, rows))) == expected_trie(kept)


def test_trie_without_rows(spark):
    assert rebuilt_prefixes(table(spark, []).limit(0)).count() == 0


def test_rebuilt_conversation_may_be_empty(spark):
    # Conversation 8 takes six turns of 5, which is absent; its own two turns are cut.
    assert zlib.crc32(b"8") % 9 >= 2
    turns = prefix_turns(table(spark, [(8, 0, "user", "a"), (8, 1, "assistant", "b")]))
    assert [r.place for r in rebuilt_turns(turns).collect()] == [0]


# Page texts ------------------------------------------------------------------------------

SENTENCE = "Some sentence of the article, with a number of words in it"


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


FURNITURE = [
    "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>",
    "<header><h1>Site name and a slogan that is quite long for a header</h1></header>",
    f'<aside class="sidebar"><p>{SENTENCE} aside</p></aside>',
    f'<div class="cookie-notice"><p>{SENTENCE} notice</p></div>',
    f'<div class="ad">{SENTENCE} advert</div>',
    f'<div id="sideBar"><p>{SENTENCE} menu</p></div>',
    f"<form><p>{SENTENCE} form</p><input name=x><button>Go</button></form>",
    f"<script>var a = '<p>{SENTENCE}</p>';</script>",
    f"<!-- <p>{SENTENCE}</p> -->",
    f'<section id="comments"><article><p>{SENTENCE} comment</p></article></section>',
    f'<div role="complementary"><p>{SENTENCE}</p></div>',
    f"<footer><p>{SENTENCE} footer &copy; somebody</p></footer>",
    "<div><a href=1>Older posts of this site</a> <a href=2>Newer posts of this site</a></div>",
]
ARTICLES = ["<article>{}</article>", "<main>{}</main>", '<div class="content"><div>{}</div></div>', '<div id="a" class="has-sidebar">{}</div>']


@pytest.mark.parametrize("shell", ARTICLES)
@pytest.mark.parametrize("seed", range(6))
def test_planted_articles_come_back_whole(shell, seed):
    rng = random.Random(seed)
    blocks = ["Title of it"] + [" ".join([f"{SENTENCE} {i} & more < less."] * rng.randrange(1, 6)) for i in range(rng.randrange(3, 9))]
    blocks.insert(3, "Les.")
    parts = [f"<h1>{blocks[0]}</h1>"] + [
        rng.choice(["<p>{}</p>", "<p>\n  {}", "<p><b>{}</b>\t</p>", "<ul><li>{}</ul>", "<blockquote><p>{}</blockquote>"]).format(escapes.escape(b))
        for b in blocks[1:]
    ]
    body = "".join(parts)
    some = rng.sample(FURNITURE, 8)
    # A header inside an article is its own, so none is planted there.
    inner = rng.choice([x for x in FURNITURE if "<header" not in x])
    text = page(shell.format(body + inner * (shell != ARTICLES[3])), "".join(some[:4]), "".join(some[4:]))
    assert main_text(text) == "\n".join(blocks)


def test_given_pages_give_their_articles(spark):
    """On the given layout, cutting by the article's tags is a brute-force extraction."""
    rows = spark.read.parquet(f"{TINY}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op12_page_text(spark, TINY).collect()}
    assert len(found) == len(rows)
    for row in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", row.html, re.DOTALL)[1]
        blocks = (re.sub(r"\s+", " ", escapes.unescape(re.sub("</?b>", "", x).replace("<br>", " "))).strip() for x in re.split("</?(?:p|h1)>", inner))
        text = "\n".join(x for x in blocks if x)
        assert (found[row.page_id].text, found[row.page_id].n_chars, found[row.page_id].url) == (text, len(text), row.url)


def test_pages_with_odd_rows(spark):
    long = "<article>" + "<p>word word word word</p>" * 20_000 + "</article>"
    rows = [
        (1, None, None, "old", 7),
        (1, "u", "", "old", 7),
        (1, "u", "", "old", 7),
        (None, "u", "<p>only one", "old", 7),
        (2**60 + 1, "u", "no tags & none", None, 7),
        (3, "u", "<div class=ad>just an advert</div>", None, 7),
        (4, "u", long, None, 7),
        (5, "u", "<p>before<!-- never closed <p>lost", None, None),
        (6, "u", "</p></div>stray<br/>ends</article><p", None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = page_texts(pages).orderBy("page_id", "n_chars").collect()
    assert [(r.page_id, r.text) for r in out if r.page_id != 4] == [
        (None, "only one"),
        (1, ""),
        (1, ""),
        (1, ""),
        (3, ""),
        (5, "before"),
        (6, "stray ends"),
        (2**60 + 1, "no tags & none"),
    ]
    assert next(r for r in out if r.page_id == 4).n_chars == 20_000 * 20 - 1
    assert page_texts(pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)
    assert 1.0 < two_means(np.array([0.0, 1.0, 1.0, 9.0, 10.0])) < 9.0
