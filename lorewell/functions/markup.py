"""One pass over a page's markup: metadata, main text, code and images of its content container."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without content, containers by preference, and where metadata stands.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = ("#js_content", "article", "main", "body")
TITLE_METAS = (("property", "og:title"), ("name", "twitter:title"))
ACCOUNT_IDS = ("js_name", "profileBt", "js_profile_qrcode")
DATE_IDS = ("publish_time", "activity-name")
INLINE_CODE_MARKS = ("def ", "class ", "return", "import ", "=", "(", ")", "[", "]", "{", "}", ":", ".", ",")

PAGE_TYPE = (
    "container string, title string, account string, published string, main_content string, "
    "code array<struct<attrs: string, content: string, pre: boolean>>, images array<string>"
)


class _Reader(HTMLParser):
    """Notes each text with the containers, the code element and the named element that hold it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.first, self.metas, self.named = [], {}, {}, {}
        self.code, self.texts, self.images, self.title = [], [], [], None

    def _holding(self):
        return {kind for kind, depth in self.first.items() if depth is not None and depth <= len(self.open)}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            for name in ("property", "name"):
                self.metas.setdefault((name, a.get(name)), a.get("content", ""))
        if tag == "img":
            self.images.append((self._holding(), [a.get(k, "").strip() for k in ("data-src", "src", "data-original")]))
        if tag in VOID:
            return
        block = next((c for _, _, c in reversed(self.open) if c is not None), None)
        if tag in ("pre", "code") and (block is None or not self.code[block]["pre"]):
            block = len(self.code)
            self.code.append({"attrs": " ".join(a.get(k, "") for k in ("class", "data-lang", "lang")).lower(), "pre": tag == "pre"})
        elif tag in ("pre", "code"):
            self.code[block]["attrs"] += " " + a.get("class", "").lower()
        self.open.append((tag, a.get("id"), block))
        for kind in (tag, "#" + a.get("id", "")):
            if kind in CONTAINERS and kind not in self.first:
                self.first[kind] = len(self.open)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]
            for kind, depth in self.first.items():
                if depth is not None and depth > at:
                    self.first[kind] = None

    def handle_data(self, data):
        tag = self.open[-1][0] if self.open else ""
        if tag == "title" and self.title is None:
            self.title = data
        if tag in ("script", "style"):
            return
        self.texts.append((self._holding(), self.open[-1][2] if self.open else None, data))
        if data.strip():
            for _, name, _ in self.open:
                if name:
                    self.named.setdefault(name, []).append(data.strip())


def _filled(values):
    return next((v for v in values if v and v.strip()), "")


def read_page(html: str, url: str) -> dict:
    """The parts of one page; blank markup gives empty parts."""
    r = _Reader()
    r.feed(html)
    r.close()
    kind = next((k for k in CONTAINERS if k in r.first), None)
    inside = [(block, text) for holding, block, text in r.texts if kind in holding]
    by_code: dict = {}
    for block, text in inside:
        if block is not None:
            by_code.setdefault(block, []).append(text)
    stripped = {b: "\n".join(t.strip() for t in ts if t.strip()) for b, ts in by_code.items()}

    def is_text(block):
        if block is None:
            return True
        t = stripped[block]
        return not r.code[block]["pre"] and not (len(t) >= 8 and ("\n" in t or any(m in t for m in INLINE_CODE_MARKS)))

    images = [_filled(values) for holding, values in r.images if kind in holding]
    images = ["https:" + v if v.startswith("//") else urljoin(url, v) for v in images if v]
    return {
        "container": kind or "",
        "title": _filled([*(r.metas.get(m) for m in TITLE_METAS), r.title]),
        "account": _filled([r.metas.get(("name", "author")), *(" ".join(r.named.get(n, [])) for n in ACCOUNT_IDS)]).strip(),
        "published": _filled([r.metas.get(("property", "article:published_time")), *(" ".join(r.named.get(n, [])) for n in DATE_IDS)]),
        "main_content": "\n".join(t.strip() for b, t in inside if t.strip() and is_text(b)),
        "code": [{"attrs": r.code[b]["attrs"], "content": "".join(ts), "pre": r.code[b]["pre"]} for b, ts in by_code.items()],
        "images": list(dict.fromkeys(images)),
    }


def _parts(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [read_page(h or "", u or "") for h, u in zip(html, url, strict=True)]
    return pd.DataFrame(rows, columns=["container", "title", "account", "published", "main_content", "code", "images"])


def page_parts(html: Column, url: Column) -> Column:
    """Struct of raw title, account, date text, main content, code elements in order, and image addresses."""
    return F.pandas_udf(_parts, PAGE_TYPE)(html, url)


def _fenced(texts: pd.Series) -> pd.Series:
    def mend(t):
        if t is None:
            return None
        lines, out, i = t.splitlines(), [], 0
        while i < len(lines):
            end = i
            while end < len(lines) and (not lines[end].strip() or lines[end][0] in " \t"):
                end += 1
            filled = code = 0
            best = None
            for j in range(end - 1, i - 1, -1):  # counts of every tail in one walk
                if lines[j].strip():
                    filled += 1
                    code += any(c in lines[j] for c in "(){}[]=+-*/<>")
                if filled >= 3 and 5 * code >= 4 * filled:
                    best = j
            if best is None:
                out += lines[i : max(end, i + 1)]
            else:
                out += [*lines[i:best], "```", *lines[best:end], "```"]
            i = max(end, i + 1)
        return "\n".join(out)

    return texts.map(mend)


def fence_code_runs(text: Column) -> Column:
    """Fences around the longest tail of each run of indented lines that is code: 3 lines filled, four fifths of them code-like."""
    return F.pandas_udf(_fenced, "string")(text)


def unescaped(text: Column) -> Column:
    """Character references of markup decoded that code is written with; ``&amp;`` last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text
