"""Which blocks of a tree go: nodes in document order, with what is left of each."""

import re
from collections.abc import Container

from .dom import Node


class Outline:
    """A tree as a table: for each node its parent's place, the end of its subtree, and the
    length of its text, blanks single, without what was dropped so far. Blocks are judged
    and dropped in the table; `cut` then removes them from the tree in one pass."""

    def __init__(self, top: Node):
        self.nodes = [top, *top.walk()]
        places = {id(n): i for i, n in enumerate(self.nodes)}
        size = len(self.nodes)
        self.up = [-1, *(places[id(n.parent)] for n in self.nodes[1:])]
        self.end = list(range(1, size + 1))
        self.said = ["" if n.tag != "#text" or (n.parent is not None and n.parent.tag in ("script", "style")) else " ".join(n.data.split()) for n in self.nodes]
        self.size = [len(s) + 1 if s else 0 for s in self.said]  # each piece and a blank
        self.here = bytearray(b"\1" * size)
        for i in range(size - 1, 0, -1):
            over = self.up[i]
            self.size[over] += self.size[i]
            self.end[over] = max(self.end[over], self.end[i])

    def left(self, i: int) -> int:
        return max(0, self.size[i] - 1)

    def words(self, i: int) -> str:
        return " ".join(self.said[j] for j in range(i, self.end[i]) if self.here[j] and self.said[j])

    def holds(self, i: int, tags: Container[str]) -> bool:
        """Whether an element with one of the tags is left below a node."""
        return any(self.here[j] and self.nodes[j].tag in tags for j in range(i + 1, self.end[i]))

    def over(self, i: int):
        """Places of the nodes around one, innermost first."""
        while (i := self.up[i]) >= 0:
            yield i

    def drop(self, i: int) -> None:
        """The whole tree's top is never dropped."""
        if i == 0 or not self.here[i]:
            return
        gone = self.size[i]
        for j in self.over(i):
            self.size[j] -= gone
        self.here[i : self.end[i]] = bytes(self.end[i] - i)

    def drop_block(self, i: int, limit: int, walls: Container[str]) -> None:
        """Drops the largest block around a node that has text of at most limit characters
        and lies inside the walls."""
        for j in self.over(i):
            if self.nodes[j].tag in walls or not 0 < self.left(j) <= limit:
                break
            i = j
        self.drop(i)

    def cut(self) -> None:
        changed = {self.up[i] for i in range(1, len(self.nodes)) if not self.here[i] and self.here[self.up[i]]}
        gone = {id(n) for n, here in zip(self.nodes, self.here, strict=True) if not here}
        for i in changed:
            over = self.nodes[i]
            for c in over.children:
                if id(c) in gone:
                    c.parent = None
            over.children = [c for c in over.children if id(c) not in gone]


# Attributes that name widgets, in order; headings and labels of widgets; the
# note of a generated audio; limits of their lengths; elements that a block stays inside of.
WIDGETS = [
    ("aria-label", "share"), ("data-testid", "share"), ("data-cy", "share"), ("data-cy", "author-image"), ("data-cy", "player"), ("data-testid", "player"), ("data-testid", "video"), ("class", "share"), ("class", "social"),
    ("class", "recommended"), ("class", "related"), ("class", "trending"), ("class", "popular"), ("class", "podcast"), ("class", "video-player"), ("class", "advertisement"), ("class", "ad-"),
]
HEADINGS = (
    "social sharing|popular now(?:\\s+in .*)?|trending videos?|discover more from .+|recommended(?: for you)?|related stories?|related articles?|related podcast|table of contents|download pdf|advertisement|listen to this article|watch\\s*\\|.*"
)
LABELS = "progress|volume|mute|unmute|play|pause|0:00|ai-generated audio|report an issue|give feedback"
AUDIO_NOTE = "This audio was generated"
WIDGET_CHARS, LABEL_CHARS = 2400, 120
LABEL_TAGS = frozenset("h1 h2 h3 h4 h5 p div span button a strong em".split())
NOTE_TAGS = frozenset("div section aside p".split())
WALLS = frozenset(["body", "html", "article", "main", "#root"])


def drop_widgets(table: Outline, marks: list[tuple[str, str]], headings: str = HEADINGS, keep: Container[str] = ()) -> None:
    """Drops marked widgets that are short, blocks with a widget's heading or audio note, and
    labels. Elements with a tag of keep below them are no headings and no labels."""
    marked = [(rank, i) for i, n in enumerate(table.nodes) if i and n.attrs for rank, (name, part) in enumerate(marks) if part in n.attrs.get(name, "").lower()]
    for _, i in sorted(marked):
        if table.here[i] and table.left(i) <= WIDGET_CHARS:
            table.drop(i)
    heading, label = (re.compile(f"(?:{words})$", re.I) for words in (headings, LABELS))
    for i, n in enumerate(table.nodes):
        if i and n.tag in LABEL_TAGS and table.here[i] and 0 < table.left(i) <= LABEL_CHARS and not (keep and table.holds(i, keep)):
            words = table.words(i)
            if heading.match(words):
                table.drop_block(i, WIDGET_CHARS, WALLS)
            elif label.match(words):
                table.drop(i)
    for i, n in enumerate(table.nodes):
        if n.tag == "#text" and AUDIO_NOTE in n.data and table.here[i]:
            box = next((j for j in table.over(i) if table.nodes[j].tag in NOTE_TAGS), 0)
            if box:
                table.drop_block(box, WIDGET_CHARS, WALLS)
