"""Documents with artifacts put in: the driver's prose has none of what cleaning repairs.

The same blocks are appended by the same rule in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Block by name: (modulus, remainder, text); every block follows a newline.
BLOCKS: dict[str, tuple[tuple[int, int, str], ...]] = {
    "numbers": (
        (2, 0, "".join(f"plain words between the leaves number {k * 7}x\n\n{k}\n\nmore words follow here\n" for k in range(11, 17))),
        (3, 0, "41\n42\n43\nthe counts above belong together\nxiv\nprose\n\nxvi\n\nprose again\nxix\n```\n77\n```\nend of it"),
        (4, 1, "".join(f"River Crossing Notes {k}\nsome line of text, {k} of them\n" for k in (3, 9, 14, 88)) + "112 River Crossing Notes\nMild Weather Report 7"),
    ),
    "boilerplate": (
        (5, 0, "".join("begin of the quiet notice\nvisit the reading room for further help\nend of the quiet notice\n" for _ in range(4)) + "after"),
        (5, 1, "".join(f"lead {k}\nthe same sentence stands here again\ntail {k}\n" for k in range(5))),
        (5, 2, "```\n" + "a line that is inside of a fence\n" * 4 + "```\n" + "# a heading that comes again and again\n" * 4),
    ),
    "toc": (
        (6, 0, "Table of Contents\n" + "".join(f"Chapter about rivers {k} .......... {k * 3}\n\n" for k in range(9)) + "This is a whole sentence among the leaders.\nshort piece\nAnother one ........ xii\nafter it"),
        (6, 1, "".join(f"Bridges and fords {k} • {k + 2}\nwords\n" for k in range(8)) + "\n".join(f"plain {k}" for k in range(8))),
        (6, 2, "lonely leader ........ 5\nprose\n" * 3),
    ),
    "tables": (
        (7, 0, "| Part | | 12 |\n|---|---|---|\n| Rivers | | iv |\n| | Lakes | 20 |\n| Seas | | 31 |\na piece\n| Ponds | | 40 |\nsecond piece of title\n\nmore\nx\ny\n| A | | 2 |\n| B | | 3 |\n| C | | 4 |\n| | D | 5 |\nThe end of the matter."),
        (7, 1, "| n | value |\n|---|---|\n" + "".join(f"| {k} | {k * k} |\n" for k in range(8)) + "done"),
        (7, 2, "```\n| a | | 1 |\n| b | | 2 |\n| c | | 3 |\n| d | | 4 |\n```\nout"),
    ),
    "chapters": (
        (8, 0, "# Chapter 1: The Upper River\nOpening words.\n## Banks\nText of banks.\n```\n# not a heading\n```\n# Chapter 2: The Lower River\n\n# stray comment\nWords.\n## Mouth\nMore.\n# Chapter 3: The Sea\nLast words."),
        (8, 1, "# One\nfirst\n# Two\n\n<!-- page 3 -->\n# Three\nthird"),
        (8, 2, "# Only one\ntext"),
        (8, 3, "Chapter 1: The Upper River\nChapter 2: The Lower River  17\nPart II. Beyond the Open Sea\nChapter 1: The Upper River\nChapter 4: Short\nThe Upper River\nbody one\nThe Lower\nRiver\nbody two\nThe Upper River\nBeyond the Open Sea\nend"),
    ),
    "characters": (
        (10, 0, "the ﬁrst de­ﬁnition of eﬀort (cid:12) non‑stop\n\n\n\nlost �� pieces � here\n\fnext page\n\n\n\nend"),
        (10, 1, "two\fpages  \n\f  and moreﬃ"),
    ),
    "bullets": (
        (11, 0, "• first thing\n  • second thing\n•\n\n•\nalpha item\nbeta item\nafter the list."),
        (11, 1, "•\nA whole sentence.\n```\n• in a fence\n```"),
    ),
    "code": (
        (12, 0, "import os\nvalue = os.getcwd()\n\nprint(value)\nAnd then the prose goes on as before.\ndef reader(path):\n    return open(path)\n\n\nmore prose"),
        (12, 1, "```python\nfunc main() {\n\nx := 1\n\nfmt.Println(x)\n}\n```\nx = 5\n```\ny = 6\n```"),
        (12, 2, "public class Reader extends Base {\n@Override\nint size() { return 3; }\n}\nfor the reader: nothing\nfor item in items:\n    total += item\n    print(total)"),
    ),
    "print": (
        (13, 0, "700123 - BookOfRivers_001-090.indd 3 4/5/19 2:13 PM\nJob No: 05-1234 Title: River Book 4/5/19 | Cyan\nThe DDrraawwiinngg LLaabb of the rivers\nJJJJoooobbbb\nbookkeeper 1100 FFEEDD\n(Ray)\nreal words stay (Text) here"),
        (13, 1, "AABBAABB\nDDoouubblleedd\nwords of mine"),
    ),
    "wrapped": (
        (9, 1, "this line is long enough to have been broken by the page width and so\ngoes on here without a stop at the end of what was one para-\ngraph of parents-in-\nlaw\n\nshort\nlines\n- item that is long enough to be wrapped but is structural after all, is\nnot joined"),
    ),
    "images": (
        (14, 0, "![a river](img/one.png) and `![code](x.png)`\n```\n![no](y.png)\n```\n![](z.png)\n![Figure 3](f.png)"),
    ),
    "fence": ((9, 0, "```\nopened and never closed\n11"),),
}


def noisy(docs: DataFrame, *names: str) -> DataFrame:
    """(doc_id, text) with the named blocks; all of them, the open fence last, where none is named."""
    text = F.col("text")
    for m, r, block in (b for n in names or BLOCKS for b in BLOCKS[n]):
        text = F.concat(text, F.when(F.col("doc_id") % m == r, F.lit("\n" + block)).otherwise(""))
    return docs.select("doc_id", text.alias("text"))


def noisy_sql(*names: str) -> str:
    """The same as the body of a common table expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"CASE WHEN doc_id % {m} = {r} THEN {quote(chr(10) + block)} ELSE '' END" for n in names or BLOCKS for m, r, block in BLOCKS[n]]
    return "SELECT doc_id, text || " + " || ".join(parts) + " AS text FROM documents"
