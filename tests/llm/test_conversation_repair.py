"""Conversation repair against a walk over all edits, and the query against it and its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lodestone.llm import conversation_repair as cr
from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def turn_faults(rows):
    """The first fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append(cr.BLANK if not body else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if body[-1] not in ".!?" else cr.FINE)
        seen.add((role, text))
    return out


def brute(rows, prices):
    """(cost, audit, lines): for each last role and turn, the least of all prefixes of edits, with up to two insertions anywhere."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for last, (c, a, lines) in list(states.items()):
                to = after[last]
                new = (c + prices.insert, a + "I", (*lines, names[to] + ":"))
                if to not in states or new < states[to]:
                    states[to] = new
        return states

    for (role, text), fault in zip(rows, turn_faults(rows), strict=True):
        new = {}
        own = dict(states)
        for last, (c, a, lines) in [*own.items(), *inserted(dict(states)).items()]:
            ways = [(last, prices.delete, "D", lines)]
            if fault not in (cr.BLANK, cr.DUPLICATE):
                more, to = prices.truncated * (fault == cr.TRUNCATED), after[last]
                if role[:1] == to or role[:1] == "s" and last == "" and not lines:
                    ways.append((role[0], more, "K", (*lines, f"{role}:{text}")))
                ways.append((to, more + prices.rerole, "R", (*lines, f"{names[to]}:{text}")))
            for to, price, edit, said in ways:
                got = (c + price, a + edit, said)
                if to not in new or got < new[to]:
                    new[to] = got
        states = new
    final = [v for last, v in [*states.items(), *inserted(dict(states)).items()] if last in ("", "a")]
    return min(final)


def letters(rows):
    roles = {"s": 0, "u": 1, "a": 2}
    return "".join(cr.LETTERS[roles.get(role[:1], 3) * 4 + f] for (role, _), f in zip(rows, turn_faults(rows), strict=True))


PRICES = [cr.Prices(), cr.Prices(2, 7, 1, 3), cr.Prices(1, 1, 1, 0), cr.Prices(3, 4, 2, 9)]


@pytest.mark.parametrize("prices", PRICES)
def test_least_edits_of_every_short_conversation(prices):
    kinds = [("system", "x."), ("user", "y."), ("assistant", "z."), ("tool", "t."), ("user", "cut"), ("assistant", "")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            rows = [(r, t and f"{i}{t}") for i, (r, t) in enumerate(rows)]
            cost, audit, lines = brute(rows, prices)
            x = letters(rows)
            to_go = cr.costs_to_go(x, tuple(prices.insert * k for k in cr.AFTER), prices)
            got, last = cr.least_edits(x, to_go, cr.START, prices)
            assert (to_go[0][cr.START], got + "I" * cr.AFTER[last]) == (cost, audit), rows
            assert LEGAL.fullmatch("".join(s[0] for s in lines))


def conversations(n, longest, seed):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua", "System"])
            rows.append((c, rng.choice([t, t, t, t * 2]), role, rng.choice(["Fine.", f"Own {t}.", f"Cut {t}", "", None, " \t", f"Ask {t}?\n", "...", f"What! {t * 'é'}."])))
    return rows


def expected(rows, prices=None):
    """The query's rows by hand."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            after += [(turn is not None, turn or 0, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        after.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3][:64].encode(), hashlib.sha256(x[3].encode()).digest()))
        said = [(r, t) for _, _, r, t in after]
        fs, turns, initials = turn_faults(said), [t for known, t, _, _ in after if known], [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = brute(said, prices or cr.Prices())
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, fs.count(1), fs.count(2), fs.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_random_conversations_in_short_segments(spark, monkeypatch):
    rows = conversations(150, 14, 1) + [(None, None, "user", None), (None, 1, "assistant", "Yes."), (None, None, None, "No."), (777, None, "user", "Hm."), (777, None, "user", "Hm.")]
    rows += [(9000, t, random.Random(t).choice(["user", "assistant", "system"]), f"Turn {t}{random.Random(t * 7).choice(['.', '!', '', '?'])}") for t in range(400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, ord int")
    want = expected(rows)
    assert got(cr.repair_damaged(df)) == want
    monkeypatch.setattr(cr, "SEGMENT_BITS", 2)  # four turns in a segment
    assert got(cr.repair_damaged(df)) == want


def test_other_prices_and_edited_turns(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_BITS", 1)
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in conversations(40, 9, 5)]
    for prices in PRICES[1:]:
        summary, edits = cr.repair(spark.createDataFrame(rows, SCHEMA), prices)
        said = {}
        for r in edits.collect():
            said.setdefault(r.conv_id, []).append(r)
        for r in summary.collect():
            mine = sorted([(t, ro, x) for c, t, ro, x in rows if c == r.conv_id], key=lambda x: (x[0], x[1].encode(), x[2].encode()))
            cost, audit, lines = brute([(ro, x) for _, ro, x in mine], prices)
            assert (r.cost, r.audit) == (cost, audit)
            assert "".join(e.edit for e in said[r.conv_id]) == audit
            assert tuple(f"{e.role}:{e.text}" for e in said[r.conv_id] if e.edit != "D") == lines
            assert all((e.turn is None) == (e.edit == "I") for e in said[r.conv_id])


def test_nothing_left_very_long_text_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 9)
    rows = [(gone, 0, "user", "Hi."), (kept, 0, "user", "long text. " * 300_000), (kept, 0, "assistant", "b" * 2_000_000 + ".")]
    found = got(cr.repair_damaged(spark.createDataFrame(rows, SCHEMA)))
    assert found == expected(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force_and_sql(spark):
    found = got(QUERIES["op11_conversation_repair"](spark, SF))
    path = f"{SF}/conversations.parquet"
    assert found == expected([tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()])
    rows = duckdb.sql(ORACLE_SQL["op11_conversation_repair"].replace("FROM conversations", f"FROM '{path}'")).fetchall()
    assert {r[0]: r[1:] for r in rows} == found
