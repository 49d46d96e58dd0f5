"""Licence texts found by canonical digests (operator 9).

A text is brought to a canonical form: lower case, no copyright lines, no
punctuation, one spelling for equivalent ones. Its digest is joined by hash to
the digests of known licences, which go through the same expressions. The whole
text has to be the licence; a licence inside a longer text is not one. Known
texts count with and without their usual titles and closing instructions.

Defined results
* null or empty text, or nothing left of it: no licence
* repeated rows are judged each by itself; no text of the table below has two
  names (a test holds that); of a caller's own, the first name by code point counts
* very long texts: one row at a time, in time by its length
* empty table: no rows; extra columns are ignored

The known side has some rows per licence, so its broadcast is bounded by the table
below (or by what the caller gives).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, each replaced as a whole word.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "organisation": "organization", "organisations": "organizations", "authorisation": "authorization",
    "authorised": "authorized", "recognised": "recognized", "favour": "favor", "honour": "honor",
    "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "noninfringement": "non infringement",
    "redistributions": "redistribution", "sublicence": "sublicense", "copyholder": "copyright holder",
    "per cent": "percent", "whilst": "while", "programme": "program", "judgement": "judgment", "wilful": "willful",
}

_AS_IS_SHORT = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Published licence texts and the notices that stand for one, by SPDX identifier.
_SHORT: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS_SHORT),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS_SHORT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Titles that the short texts go by, besides none.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero Clause BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
}
#: The published long texts, a file for each SPDX identifier, and how many lines of title each has.
_FOLDER = Path(__file__).parent / "licence_texts"
_TITLE_LINES = {"Apache-2.0": 3, "MPL-1.1": 3, "Artistic-1.0-Perl": 1, "BSD-3-Clause": 0, "Unlicense": 0}
_END = re.compile(r"^[ ]*END OF TERMS AND CONDITIONS[ ]*$", re.M)
_CLOSING = re.compile(r"^[ ]*(?:ADDENDUM: How to|EXHIBIT A -|Exhibit A - )", re.M)


def _variants() -> Iterator[tuple[str, str]]:
    """Texts with each usual title and with none; long ones also without what follows their terms."""
    yield from _SHORT
    for name, text in _SHORT[:5]:
        body = text.split("\n\n", 1)[-1]
        for title in ("", *_TITLES[name]):
            yield name, f"{title}\n\n{body}"
            if name.startswith("BSD"):
                yield name, f"{title}\n\nAll rights reserved.\n\n{body}"
    for path in sorted(_FOLDER.glob("*.txt")):
        name, whole = path.stem, path.read_text()
        lines = whole.strip().split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        untitled = "\n".join(lines[full[_TITLE_LINES.get(name, 2)] :])
        if name == "Unlicense":
            untitled = f"The Unlicense\n\n{whole}"
        for text in (whole, untitled):
            yield name, text
            if end := _END.search(text):
                yield from ((name, text[: end.start()]), (name, text[: end.end()]))
            if closing := _CLOSING.search(text):
                yield name, text[: closing.start()]
            if name == "Apache-2.0":  # the line goes with the copyright lines once it is filled in
                yield name, text.replace("Copyright [yyyy] [name of copyright owner]", "")


#: Texts of http and https addresses are told apart by their words, so both are known.
KNOWN: tuple[tuple[str, str], ...] = tuple(
    dict.fromkeys((n, x) for name, text in _variants() for n, x in ((name, text), (name, text.replace("https://", "http://")), (name, re.sub("http://", "https://", text))))
)


def canonical(text: Column) -> Column:
    """The canonical form of a text, words apart by one space."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kept = F.regexp_replace(low, r"(?m)^[^\p{L}\n]*(?:copyright\b[^\n]*(?:\d{4}|\(c\)|©|<)|©|\(c\))[^\n]*$", " ")
    plain = F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " ")
    # two spaces between words, so that each has its own
    words = F.concat(F.lit(" "), F.replace(F.btrim(plain), F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, one in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one} "))
    return F.regexp_replace(F.btrim(words), " +", " ")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    texts = spark.createDataFrame(list(known), "license string, body string")
    return texts.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license`` of every document; ``license`` is null if the text is none."""
    known = known_digests(docs.sparkSession) if known is None else known
    digests = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return digests.join(F.broadcast(known.groupBy("digest").agg(F.min("license").alias("license"))), "digest", "left").select("doc_id", "digest", "license")
