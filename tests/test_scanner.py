import random

import pytest

from rowatlas.sources.scanner import CSV, LINES, QUOTED, RECORD, STATES, TSV, Dialect, Scanner, outcome, plain_block, spans


def cut(data: bytes, dialect=CSV) -> list[bytes]:
    return [data[s:e] for s, e in spans(data, dialect).spans]


def slow(data: bytes, delimiter=44, quote=34) -> list[tuple[int, int]]:
    """A byte at a time, independent of the scanner."""
    out, start, at, field, quoted, closed = [], 0, 0, True, False, False
    pending = False
    while at < len(data):
        b = data[at]
        if quoted:
            if b == quote:
                quoted, closed = False, True
        elif closed and b == quote:
            quoted, closed = True, False
        elif b in (10, 13):
            out.append((start, at))
            if b == 13 and data[at + 1 : at + 2] == b"\n":
                at += 1
            start, field, closed, pending = at + 1, True, False, False
            at += 1
            continue
        elif b == delimiter:
            field, closed, pending = True, False, True
            at += 1
            continue
        elif b == quote and field:
            quoted = True
        else:
            closed = False
        field, pending = False, True
        at += 1
    if start < len(data):
        out.append((start, len(data)))
    return out


def test_records_of_every_kind():
    data = b'a,b\r\n"multi\r\nline","escaped ""quote"""\n\rbare,cr\rlast,'
    assert cut(data) == [b"a,b", b'"multi\r\nline","escaped ""quote"""', b"", b"bare,cr", b"last,"]


def test_unterminated_quote():
    got = spans(b'ok\n"never\nclosed')
    assert len(got.spans) == 2 and got.diagnostic == ("unterminated_quoted_field", 16, 3)
    assert spans(b'a,"x"\n').diagnostic is None


@pytest.mark.parametrize(("data", "want"), [(b"", []), (b"\n", [(0, 0)]), (b"a\n\n", [(0, 1), (2, 2)]), (b"a\r\nb\rc", [(0, 1), (3, 4), (5, 6)]), (b'"a\nb"', [(0, 2), (3, 5)])])
def test_lines(data, want):
    assert spans(data, LINES).spans == want


def test_malformed_file():
    data = b'id,name,notes\r\n1,alpha,valid\r\n2,beta,extra,column\r\n3,ga"mma,unescaped-quote\r\n4,delta,"quoted\r\nmultiline"\r\n5,epsilon,"unterminated'
    assert len(cut(data)) == 6
    assert spans(data).diagnostic[0] == "unterminated_quoted_field"


def test_random_bytes_agree_with_a_slow_walk_for_every_block_size():
    rng = random.Random(7)
    for _ in range(512):
        data = bytes(rng.choice(b'ab,"\r\n\t\0\xff') for _ in range(rng.randrange(257)))
        want = slow(data)
        assert spans(data).spans == want
        for size in (1, 2, 3, 7, 31):
            state, starts = RECORD, 0
            for at in range(0, len(data), size):
                o = outcome(data[at : at + size], CSV)
                state, starts = o.states[state], starts + o.starts[state]
            assert starts == len(want)


def test_outcome_equals_a_walk_from_each_state():
    rng = random.Random(8)
    for _ in range(200):
        data = bytes(rng.choice(b'ab,"\r\n') for _ in range(60))
        o = outcome(data, TSV if rng.random() < 0.2 else CSV)
        o = outcome(data, CSV)
        for entry in STATES:
            seen = []
            state, _ = Scanner(CSV).scan(data, entry, seen.append, lambda _: True)
            assert (o.states[entry], o.starts[entry]) == (state, len(seen))


def test_dialects():
    assert cut(b"a\t\"b\n\"\nc", TSV) == [b'a\t"b\n"', b"c"]
    for bad in ((44, 44), (10, 34), (44, 13)):
        with pytest.raises(ValueError):
            Dialect(*bad)
    assert QUOTED in STATES


def test_blocks_without_quotes_agree_with_a_walk():
    rng = random.Random(11)
    for k in range(600):
        data = bytes(rng.choice(b"ab,\r\n") for _ in range(rng.randrange(1, 12)))
        for dialect in (CSV, LINES):
            for entry in STATES:
                if entry == QUOTED or (dialect is LINES and entry == 4):
                    continue
                starts, ends = [], []
                state, _ = Scanner(dialect).scan(data, entry, starts.append, ends.append)
                got = plain_block(data, entry, dialect)
                assert (got[0].tolist(), got[1].tolist()) == (starts, ends)
                assert got[2] == state or {got[2], state} <= {1, 2}  # inside a record either way
    assert plain_block(b'a"', RECORD, CSV) is None
