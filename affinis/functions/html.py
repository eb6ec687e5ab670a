"""Text of page elements by class, on the standard library's HTML tokenizer."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class DivTexts(HTMLParser):
    """Collects, for every ``div`` with one of the wanted classes, the texts of its children."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.found = []  # (class, child texts) in document order
        self.path = []  # open elements: (tag, child texts per wanted class or None)
        self.fresh = True  # the next text starts a new child

    def handle_starttag(self, tag, attrs):
        self._new_child()
        self.fresh = True
        classes = dict(attrs).get("class") or "" if tag == "div" else ""
        hits = [c for c in classes.split() if c in self.wanted]
        children = [] if hits else None
        for name in hits:
            self.found.append((name, children))
        if tag not in VOID:
            self.path.append((tag, children))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _new_child(self):
        # an element opening directly below a wanted div is one child of it
        if self.path and self.path[-1][1] is not None:
            self.path[-1][1].append("")

    def handle_endtag(self, tag):
        for depth in range(len(self.path) - 1, -1, -1):
            if self.path[depth][0] == tag:
                del self.path[depth:]
                break
        self.fresh = True

    def handle_comment(self, data):
        self.fresh = True

    def handle_data(self, data):
        if any(tag in ("script", "style") for tag, _ in self.path):
            return
        for depth, (_, children) in enumerate(self.path):
            if children is None:
                continue
            if depth == len(self.path) - 1 and self.fresh:
                children.append(data)
            elif children:
                children[-1] += data
        self.fresh = False


def div_texts(html: str, wanted) -> dict[str, list[str]]:
    parser = DivTexts(wanted)
    parser.feed(html)
    parser.close()
    out = {name: [] for name in wanted}
    for name, children in parser.found:
        out[name].append(" ".join(c for c in children if c))
    return out


def parse_batches(batches, header_class: str, message_class: str, extra_class: str):
    wanted = (header_class, message_class, extra_class)
    for batch in batches:
        headers, messages, extras, errors = [], [], [], []
        for html in batch.column("html").to_pylist():
            error = None
            try:
                texts = div_texts(html, wanted)
            except Exception as failure:  # a page that cannot be read counts as an empty one
                texts, error = {name: [] for name in wanted}, f"{type(failure).__name__}: {failure}"
            errors.append(error)
            headers.append(texts[header_class][0] if texts[header_class] else "")
            messages.append(texts[message_class])
            extras.append(texts[extra_class][0] if texts[extra_class] else None)
        keys = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "html"]
        names = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays(
            [
                *keys,
                pa.array(headers, pa.string()),
                pa.array(messages, pa.list_(pa.string())),
                pa.array(extras, pa.string()),
                pa.array(errors, pa.string()),
            ],
            names=[*names, "header", "messages", "extra", "error"],
        )
