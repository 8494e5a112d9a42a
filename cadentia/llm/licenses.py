"""Licence scan by canonical digest: a text is a licence if its canonical form is that of a known one.

The canonical form lower-cases A-Z, writes copyright marks and equivalent spellings alike, drops copyright
notices, and keeps only letters and digits, two blanks between words. Its SHA-256 is joined with the digests
of the known texts.
"""

from __future__ import annotations

import re
import string
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import small_or_plain

# Spellings that count as one, first the variant, then what stands for it.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasise", "emphasize"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("sublicence", "sublicense"), ("https", "http"),
]

# Known licences and notices, by SPDX identifier.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
KNOWN = [
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_REST}"),
    ("MIT", f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_REST}"),
    ("MIT-0", f"{_MIT_GRANT}.\n\n{_MIT_REST}"),
    ("BSD-2-Clause", _BSD_TWO + _BSD_REST),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THREE + _BSD_REST),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_REST}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]

#: Headings that templates put before the texts of ``KNOWN``.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
#: Whole texts of longer licences, ``<SPDX identifier>.txt``.
TEXTS = files("cadentia.llm") / "license_texts"
#: Where advice on how to apply a licence follows its terms; many copies end before it.
END_OF_TERMS = r"(?m)^[ \t]*(?:APPENDIX: How to apply|(?:Appendix: )?How to Apply These Terms|ADDENDUM: How to use this License)"

#: What follows "copyright" or "(c)" in the sentences of licences, not in notices.
_IN_SENTENCE = "|".join([
    "a", "act", "acts", "all", "an", "and", "any", "are", "as", "at", "by applicable", "by law", "claim", "claims", "disclaimer", "disclaimers", "doctrine", "doctrines", "for", "grant", "holder", "holders", "if", "in", "information",
    "infringement", "interest", "interests", "is", "it", "its", "law", "laws", "legend", "legends", "license", "licenses", "licence", "licences", "may", "must", "no", "not", "notice", "notices", "of", "on", "or", "owner",
    "owners", "ownership", "permission", "permissions", "protection", "resulting", "right", "rights", "statement", "statements", "status", "such", "that", "this", "to", "treaty", "under", "use", "when", "where", "which", "with", "you",
])
#: A line that only names a holder of rights: comment marks, then a copyright mark with a sign, year or blank to fill in,
#: or with a name that is no sentence's next word, if the line ends its paragraph or another mark follows.
COPYRIGHT_LINE = (
    r"(?m)^[ \t#*/;.-]*(?:©|copyrights?[ \t:,]*(?:\(c\)|©|&copy;|[0-9]{4}|[<\[{])|\(c\)[ \t:,]*(?:copyright\b|©|[0-9]{4}|[<\[{])|\(c\)[^\n]*\b(?:19|20)[0-9]{2}[.,]?[ \t]*$"
    rf"|(?:copyrights?|\(c\))(?=[ \t:])(?![ \t:]*(?:{_IN_SENTENCE})\b)(?=[^\n]*(?:\n[ \t\r#*/;.-]*(?:\n|©|\(c\)|copyright|all rights reserved|\z)|\z)))[^\n]*$"
)
#: The words of a notice, and those that a line break divides.
DIVIDED = r"all(?:[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*rights[^\p{L}\p{N}]+|[^\p{L}\p{N}]+rights[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*)reserved\b\.?"
RESERVED = r"all[^\p{L}\p{N}]+rights[^\p{L}\p{N}]+reserved\b\.?"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null for null, a single blank pair or empty for a text without letters and digits."""
    out = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    out = F.regexp_replace(out, "\r\n?", "\n")  # line ends of any system
    out = F.regexp_replace(out, DIVIDED, "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, RESERVED, "")
    out = F.concat(F.lit("  "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    for variant, plain in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {plain} "))
    return F.trim(out)


def known_texts() -> list[tuple[str, str]]:
    """Identifier and text: the short ones with numbered and plain lists and with their headings, and the long ones."""
    out = list(KNOWN)
    for name, text in KNOWN:
        if name in TITLES and not text.startswith(TITLES[name][0]):
            plain = re.sub(r"(?m)^[0-9]\. ", "", text)
            forms = [text] + [plain] * (plain != text)
            out += [(name, form) for form in forms[1:]] + [(name, f"{title}\n\n{form}") for title in TITLES[name] for form in forms]
    for file in sorted(TEXTS.iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
            terms = re.split(END_OF_TERMS, text, maxsplit=1)[0]
            out += [(name, text)] + [(name, terms)] * (terms != text)
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, license_text string")


def scan_licenses(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null if the text is no known licence) of every row.

    ``known`` has license_id and license_text; of several licences with one canonical form the first id in
    code point order counts. A null text has a null digest; a text without letters or digits matches
    nothing, nor does such a licence text. Texts of any length are taken whole. Repeated rows give repeated rows; an empty table gives
    none; other columns are ignored.
    """
    known = known_licenses(spark) if known is None else known
    form = canonical(F.col("license_text"))
    digests = known.where(F.length(form) > 0).groupBy(F.sha2(form, 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return rows.join(small_or_plain(digests, known.count()), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")


# The SQL's own fixed values: any line after a copyright mark goes, and the words with their period.
_SQL_COPYRIGHT_LINE = r"(?m)^[ \t#*/;.-]*(copyright|\(c\)|©)[^\n]*$"
_SQL_RESERVED = "all rights reserved."


def _sql_canonical(text: str) -> str:
    out = f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    out = f"regexp_replace({out}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '{_SQL_COPYRIGHT_LINE}', '', 'g')"
    out = f"replace({out}, '{_SQL_RESERVED}', '')"
    out = f"('  ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  ')"
    for variant, plain in SPELLINGS:
        out = f"replace({out}, ' {variant} ', ' {plain} ')"
    return f"trim({out})"


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
with known as (
  select sha256({_sql_canonical("license_text")}) as digest, min(license_id) as license_id
  from (values {rows}) as k(license_id, license_text) group by 1)
select doc_id, sha256(c) as canonical_sha256, license_id
from (select doc_id, {_sql_canonical("text")} as c from documents) left join known on sha256(c) = digest
"""
