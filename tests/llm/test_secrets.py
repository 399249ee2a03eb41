import base64
import gzip
import hashlib
import re
import tracemalloc
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curvelark.llm import secrets as S
from tests.llm.util import docs_frame

SECRET = "token = abcdef0123456789XYZ"
b64 = lambda s: base64.b64encode(s.encode() if isinstance(s, str) else s).decode()
percent = lambda s: "".join(f"%{c:02X}" for c in s.encode())
escape = lambda s: "".join(f"\\u{ord(c):04x}" for c in s)
packed = lambda s: b64(gzip.compress(s.encode()))


def plain(text):
    named = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in named.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


@given(st.text(alphabet="abf019AKIZ=: \"'tokenpswd_%\\é\n", max_size=120))
def test_base_matches_are_those_of_the_patterns(text):
    assert sorted(S.scan(text)) == sorted(plain(text))


def test_case_folding_is_ascii_only():
    assert S.scan("\u017fecret: abcdefghijklm") == [] and S.scan("to\u212aen: abcdefghijklm") == [] and len(S.scan("ToKEN: abcdefghijklm")) == 1
    assert S.scan("token=password:abcdefghijklmn") == []  # the failing match takes the word that would begin another


@pytest.mark.parametrize("wrap", [b64, percent, escape, packed, lambda s: b64(zlib.compress(s.encode())), lambda s: b64(percent(s)), lambda s: percent(b64(s)), lambda s: b64(b64(b64(s))), lambda s: escape(packed(s)), lambda s: b64(s).rstrip("=").replace("+", "-").replace("/", "_")])
def test_nested_layers_map_to_the_text(wrap):
    code = wrap(SECRET)
    base, spans, layers, refused = S.deep_scan("é pre " + code + " post")
    assert layers >= 1 and refused == 0
    outer = [s for s in spans if s[0] == "assign"]
    assert outer and all(6 <= a < b <= 6 + len(code) for _, a, b in outer)
    assert set(base) <= set(spans)


def test_a_part_of_a_layer_maps_to_its_part():
    left = percent("hello world ")
    _, spans, _, _ = S.deep_scan(left + percent(SECRET))
    assert ("assign", len(left), len(left) + 3 * len(SECRET)) in spans


def test_cycles_bombs_and_junk_end():
    assert S.deep_scan("%25" * 2000)[2] >= 1
    assert S.deep_scan("%2525252525252561")[2] > 3
    assert S.deep_scan("%ff%fe \\uD800 \\U99999999 " + "A" * 4001)[2] >= 0


def test_redaction():
    text = "x " + SECRET + " y"
    _, spans, _, _ = S.deep_scan(text)
    assert S.redacted(text, spans) == "x [assign removed] y"


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, "AKIA" + "A" * 14), (4, "w " * 200_000 + SECRET)]
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.spans) for r in S.scan_documents(docs_frame(spark, rows, extra=True), ["doc_id"]).collect()))
    assert [g[:4] for g in got] == [(0, 0, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 1), (3, 1, 0, 1), (4, 1, 0, 1)]
    assert got[3][4] == "assign:0:27,hex:8:24" and got[5][4].startswith("assign:400000:")
    clean = S.scan_documents(docs_frame(spark, rows), ["doc_id"], clean=True).where("doc_id = 1").first()
    assert clean.clean_text is None
    assert S.scan_documents(docs_frame(spark, []), ["doc_id"]).count() == 0


FACE = "\U0001f468\u200d\U0001f469 "
gz = gzip.compress
lines = lambda s, n=76: "\n".join(s[i : i + n] for i in range(0, len(s), n))


@pytest.mark.parametrize("code", [
    *(b64(c + SECRET) for c in (FACE, "\u200c", "\u00ad", "\ufeff", "id\0")), b64(gz((FACE + SECRET).encode())), b64(b"caf\xe9 " + SECRET.encode()),
    b64(gz(gz(SECRET.encode()))), b64(zlib.compress(gz(SECRET.encode()))), b64(gz(b64(gz(SECRET.encode())).encode())),
    "%E9" + percent(SECRET), percent(SECRET) + "%E9", "\\U99999999" + escape(SECRET), "%2541%E9" + percent(b64(SECRET)),
    *(g + b64(SECRET) for g in ("https://h.example/cb/", "key-", "a_", "ab/", "abc-", "/")), *(g + b64(gz(SECRET.encode())) for g in ("key-", "a_", "x/y/")), b64(SECRET) + "x", b64(SECRET).rstrip("=") + "/tail",
    *(lines(b64("x" * p + " " + SECRET), n) for p in (40, 45, 50, 55) for n in (76, 64, 10)), lines(b64("x" * 50 + " " + SECRET)).replace("\n", "\r\n\t"), lines(b64("x" * 50 + " " + SECRET)).replace("\n", "\\n"), "-----BEGIN X-----\n" + lines(b64("x" * 50 + " " + SECRET), 64),
    lines(b64(gz((hashlib.sha512(b"a").hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) * 3 + " " + SECRET).encode()))),
    b64(gz(b"one ") + gz(SECRET.encode())), b64(gz(b"token = abcdef") + gz(b"0123456789XYZ")), b64(gz(SECRET.encode())[:-6]), b64(gz(SECRET.encode())[:-8] + b"12345678"),
    "".join(f"\\x{c:02x}" for c in gz(SECRET.encode())), "".join(f"%{c:02x}" for c in gz(SECRET.encode())), "".join(f"%{c:02x}" for c in zlib.compress(SECRET.encode(), 9)),
])
def test_no_part_of_a_layer_costs_the_rest(code):
    text = "é pre " + code + " post"
    _, spans, _, _ = S.deep_scan(text)
    assign = [s for s in spans if s[0] == "assign"]
    assert assign and all(6 <= a < b <= 6 + len(code) for _, a, b in assign)
    assert SECRET not in S.redacted(text, spans) and not any(k == "assign" for k, _, _ in S.deep_scan(S.redacted(text, spans))[1])


def test_glued_base64_maps_to_its_groups():
    _, spans, _, _ = S.deep_scan("abc-" + b64("xyz" + SECRET))
    assert ("assign", 8, 4 + len(b64("xyz" + SECRET))) in spans


def test_wrapped_lines_map_over_the_break():
    code = lines(b64("x" * 51 + SECRET))
    _, spans, _, _ = S.deep_scan("é " + code + " post")
    assert ("assign", 2 + 68, 2 + len(code)) in spans


@pytest.mark.parametrize("data", [b"0" * 16, b"AKIA" + b"A" * 14, b"deadbeef" * 2, b"token=" + b"x" * 12])
@pytest.mark.parametrize("pad", [True, False])
def test_short_runs_of_compressed_secrets(data, pad):
    for raw in (zlib.compress(data), zlib.compress(data, 9), zlib.compress(data, 1), zlib.compress(data, wbits=9), gzip.compress(data)):
        code = b64(raw) if pad else b64(raw).rstrip("=")
        for text, at in ((f"an {code} end", 3), (f"x-{code}", 0), (code, 0)):
            _, spans, _, _ = S.deep_scan(text)
            assert any(at <= a < b <= at + len(code) + 2 for _, a, b in spans), (code, text)


def test_layers_of_any_size(monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 50_000)
    monkeypatch.setattr(S, "OVERLAP_BYTES", 2_000)
    noise = hashlib.shake_256(b"x").hexdigest(80_000).translate(str.maketrans("0123456789abcdef", "ghijklmnopqrstuv")).encode()
    for k in (0, 51_990, 123_456):
        data = noise[:k] + b" " + SECRET.encode() + b" " + noise[k:]
        for raw in (gzip.compress(data), zlib.compress(data), gz(data[:70_000]) + gz(data[70_000:]), gzip.compress(noise[:k] + b" " + b64(gz(SECRET.encode())).encode() + b" " + noise[k:])):
            code = b64(raw)
            _, spans, _, refused = S.deep_scan("pre " + code + " post")
            assert refused == 0 and any(kind == "assign" and 4 <= a < b <= 4 + len(code) for kind, a, b in spans)
    bomb = b64(zlib.compress(b"a" * 3_000_000 + SECRET.encode(), 9))
    assert [k for k, _, _ in S.deep_scan(bomb)[1]].count("assign") == 1
    monkeypatch.setattr(S, "MAX_DOCUMENT_BYTES", 1_000_000)
    assert S.deep_scan(bomb)[3] == 1


WRAPS = [b64, percent, escape, packed, lambda s: b64(zlib.compress(s.encode())), lambda s: "".join(f"\\x{c:02x}" for c in s.encode()), lambda s: "".join(f"%{ord(c):02x}" if not c.isalnum() and ord(c) < 128 else c for c in s), lambda s: lines(b64(s), 60)]


@settings(max_examples=150, deadline=None)
@given(chain=st.lists(st.sampled_from(range(len(WRAPS))), min_size=1, max_size=4), before=st.text(alphabet="xyz é,.\n", max_size=12), after=st.text(alphabet="xyz é,.\n", max_size=12))
def test_any_nesting_is_unwrapped(chain, before, after):
    """Wrapped in any order: the secret's span lies in what it was wrapped to, and nothing of it is left when spans are cut out."""
    code = SECRET
    for k in chain:
        code = WRAPS[k](code)
    text = f"{before} {code} {after}"
    base, spans, _, refused = S.deep_scan(text)
    at = len(before) + 1
    assert refused == 0 and set(base) <= set(spans)
    assert any(k == "assign" and at <= a < b <= at + len(code) for k, a, b in spans)
    assert not any(k == "assign" for k, _, _ in S.deep_scan(S.redacted(text, spans))[1])


def test_a_long_text_that_decodes_is_held_in_little_memory():
    text = ("word " * 400_000) + "%41" * 700_000 + " " + percent(SECRET) + " " + lines(b64("x" * 2_000_000))
    tracemalloc.start()
    _, spans, _, _ = S.deep_scan(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = 5 * 400_000 + 2_100_000 + 1
    assert ("assign", at, at + 3 * len(SECRET)) in spans and most < 25 * len(text)


def test_short_layers_between_others():
    """Layers shorter than any secret, that unfold further."""
    inner = zlib.compress(b"a" * 64)
    assert len(inner) < 16
    for code in (base64.b64encode(gzip.compress(inner)).decode(), base64.b64encode(zlib.compress(gzip.compress(inner))).decode()):
        _, spans, _, _ = S.deep_scan("x " + code + " y")
        assert [k for k, a, b in spans if 2 <= a < b <= 2 + len(code)] == ["hex"]


@pytest.mark.parametrize("coding", ["utf-16-le", "utf-16-be", "utf-16"])
def test_two_bytes_a_character(coding):
    """Encoded shell commands, and codings within."""
    for text in ("Zażółć " + SECRET + " gęślą", "run " + base64.b64encode(gzip.compress(SECRET.encode())).decode()):
        code = base64.b64encode(text.encode(coding)).decode()
        _, spans, _, _ = S.deep_scan("pwsh -e " + code)
        found = [s for s in spans if s[0] == "assign"]
        assert found and all(8 <= a < b <= 8 + len(code) for _, a, b in found)
    plain = "".join(c + "\0" for c in SECRET)
    assert ("assign", 2, 2 + len(plain)) in S.deep_scan("é " + plain)[1]
