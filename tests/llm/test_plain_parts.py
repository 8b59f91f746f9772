"""Parts that need no Spark: page reading, guess costs, tries, and the fixed patterns against their plain forms."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from causalrisk.llm.extract import page_text, page_votes
from causalrisk.llm.jaccard import Trie, folded, need, ordered, parity_bits, prefix_size
from causalrisk.llm.personal_data import entities
from causalrisk.llm.secret_scan import KINDS, base_secrets, context_secrets, guess_cost
from causalrisk.llm.words import ALNUM, NOT_SPACE, gram_hashes, text_chunks
from tests.llm import cases

PAGES = [
    ("<p>One<p>Two &amp; &#8364; <i>th</i>ree", "One\nTwo & € three"),
    ("<html><body><div id=sidebar><p>links here</div><main><h1>T</h1><p>a\n b<br>c</p></main></body>", "T\na b c"),
    ("<article><header><h1>Title</h1></header><p>text of it<p>more<div class='comments'><p>nice!</div><aside>see also</aside></article>", "Title\ntext of it\nmore"),
    ("<body><header><p>Site</header><article><p>long text of the article</p><form><p>mail</p></form></article><div class='cookie-notice'>ok</div>", "long text of the article"),
    ("<article><p>a</p><script>var x='</p><p>no';</script><style>p{}</style><!-- <p>no --><p>b</article>", "a\nb"),
    ("<div class=ad><p>buy<article><p>never closed above</article>", "never closed above"),
    ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"),
    ("<article><p>5 < 6 and a<b>c</b></p></article>", "5 < 6 and ac"),
    ("<p>&am &lt;b&gt; &nbsp; x</p>", "&am <b> x"),
    ("<div class='content with-sidebar'><p>kept text</p><div class='share-links'>share</div></div>", "kept text"),
    ("", ""), ("<", "<"), ("<!-- open", ""), ("<div hidden>x</div><p>y", "y"), ("text only", "text only"),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_pages(source, text):
    assert page_text(source, None) == text


def test_votes_are_shares_and_deep_or_broken_pages_end():
    votes = page_votes("<body><article class='post-12'><p>a long text</p></article><div><p>b</p></div>")
    assert max(votes, key=votes.get) == "body>article.post-#" or max(votes, key=votes.get).endswith("article.post-#")
    assert sum(votes.values()) == pytest.approx(1.0)
    assert page_text("<div>" * 3000 + "x" + "</div>" * 3000, None) == "x"
    assert page_text("<a \"" * 2000 + "<p>end", None) == "end"


def test_words_equal_the_plain_patterns():
    texts = [r[1] for r in cases.documents()]
    for table, pattern in ((NOT_SPACE, cases.NOT_SPACE), (ALNUM, cases.ALNUM)):
        got, seen = [], {}
        for a, b, w in text_chunks(pa.array(texts), table):
            data, hashes = w.bytes.tobytes(), w.hashes()
            for i in range(b - a):
                own = [data[w.start[k] : w.end[k]].decode() for k in range(w.first[i], w.first[i + 1])]
                assert all(seen.setdefault(x, h) == h for x, h in zip(own, hashes[w.first[i] : w.first[i + 1]].tolist(), strict=True))
                got.append(own)
        assert got == [cases.words(t, pattern) for t in texts] and len(set(seen.values())) == len(seen)
    h = np.array([5, 7, 5, 7, 5], dtype=np.uint64)
    g = gram_hashes(h, 2)
    assert g[0] == g[2] != g[1] == g[3] and len(gram_hashes(h, 6)) == 0


def test_trie_finds_all_links_and_filters_drop_none():
    draw = random.Random(4)
    base = [np.array(sorted(draw.sample(range(1, 400), draw.randint(1, 60))), dtype=np.uint64) for _ in range(8)]
    sets = []
    for i in range(150):
        s = set(base[i % 8].tolist())
        for _ in range(draw.randint(0, 6)):
            s.symmetric_difference_update({draw.randint(1, 400)})
        sets.append(np.array(sorted(s or {1}), dtype=np.uint64))
    frequent = np.array([3, 50, 77], dtype=np.uint64)
    rank = np.array([2, 0, 1])
    order = [ordered(s, frequent, rank)[0] for s in sets]
    trie = Trie(list(enumerate(order)))
    for i, s in enumerate(order):
        want = {j for j in range(150) if j != i and 100 * len(set(s.tolist()) & set(order[j].tolist())) >= 80 * len(set(s.tolist()) | set(order[j].tolist()))}
        assert set(trie.links(s, 80, False, i, step=7)) == want
        assert bool(trie.links(s, 80, True, i)) == bool(want)
        for j in want:
            assert set(s[: prefix_size(len(s))].tolist()) & set(order[j][: prefix_size(len(order[j]))].tolist())
            a, b = (np.frombuffer(parity_bits(x), dtype=np.uint8) for x in (sets[i], sets[j]))
            width = min(len(a), len(b))
            apart = int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())
            assert apart <= len(s) + len(order[j]) - 2 * need(len(s), len(order[j]))


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_fixed_patterns_equal_their_plain_forms():
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    keep = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    draw = random.Random(1)
    for _ in range(20000):
        t = "".join(draw.choice(draw.choice(["0123456789", "ab@.", "+-() ", "4 1-", "@a.", "1.2.", "é"])) for _ in range(draw.randint(0, 40)))
        assert entities(t) == [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, t) if keep[k](m.group())]
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    parts = ["password", "Token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "secret", "===", "é", "ſecret"]
    for _ in range(20000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m.group(1)) >= 8]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
        want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 32]
        assert base_secrets(t) == sorted(want, key=lambda s: (s[1], KINDS.index(s[0])))


def test_guess_costs():
    assert guess_cost("") == 0 and guess_cost("password") < 1 < guess_cost("Password1") < 2.5
    assert all(guess_cost(v) < 5 for v in ("qwertyuiop", "aaaaaaaaaaaa", "abcdefgh", "19991231", "changeme123", "P4ssw0rd"))
    assert all(guess_cost(v) > 9 for v in ("xK9#mQ2$vL7", "7f3kQ9zL", "Tr0ub4dor&3"))
    assert guess_cost("a" * 5000) < 8 and guess_cost("xK9#mQ2$vL7" * 300) > 3000

    def cheapest(v):  # no cut is cheaper than the reported one by its own single characters
        return sum(np.log10((10 if c.isdigit() else 26 if c.isalpha() else 33) * (2 if c.isupper() else 1)) for c in v)

    assert all(guess_cost(v) <= cheapest(v) + 1e-9 for v in ("zq9X", "Summer2024!", "tiger tiger", "éa1"))
    text = "the password is xK9#mQ2$vL7. passphrase: Summer2024! secret is something pwd = 'Zz81kfQp3' token: short1"
    assert [text[s:e] for _, s, e in context_secrets(text, [])] == ["xK9#mQ2$vL7", "Zz81kfQp3"]
    assert context_secrets(text, [("assign", 0, len(text))]) == []
