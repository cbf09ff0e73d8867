"""License scans by canonical digest.

A text is brought into a canonical form (case, punctuation, copyright lines, equivalent spellings, white space) and
hashed; whole texts are then hash-joined to the digests of known license texts.  The same is done for each whole
line, so that a one-line notice inside a longer document is found too.  The table of known texts is fixed by the
caller and holds a few hundred rows at most, so the join broadcasts it and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spellings that the matching guidelines of license lists treat as the same.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

#: License texts, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE IS",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS",
)

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Canonical digests of public license texts, whole as their stewards publish them.
WHOLE = (
    ("Apache-2.0", "dbb777d3ad1fb948fbe99e6748cbd3fea3f269381f3f7efe3f4259a28a9269c9"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "dca4c975ceb5ed80ec4b97c7ae03c9f0723ade327cf297a7e745f117af15b9d3"),
    ("MPL-2.0", "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5"),
)
#: The same without what follows "END OF TERMS AND CONDITIONS".
TERMS = (
    ("Apache-2.0", "37aa90548985ac0057637d42c3153e8b5d107a21d9556d7fbe60e3e426fdacaa"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
)

#: Words after "copyright" or "(c)" that belong to a sentence of a license and name no holder.
BODY = r"notices?|holders?|holder's|owners?|laws?|licen[cs]es?|statements?|interests?|protection|rights?|status|disclaimers?|and|or|nor|in|on|of|to|is|are|as|for|if|that|which|with|under|such|this|your|you|any|all|a|an|shall|may|must|does|do|not"
#: What ends a claim on the same line: the license that goes with it.
GRANT = r"(?:licen[cs]ed|released|distributed|published|available) under|permission (?:is|to)|redistribution and|this [a-z]+ is (?:free|licen[cs]ed|released|distributed|provided|published|made)"
#: A claim of a copyright at the start of a line, to the line's end or to the license that it names.
CLAIM = (
    r"(?m)^[^\n0-9A-Za-z]*(?:"
    r"(?:copyright|\(c\)|©)(?:[ \t,:]*(?:copyright|\(c\)|©))+"  # a sign
    r"|©"
    r"|(?:copyright|\(c\))(?:[ \t,:]|by )*[0-9]{4}\b"  # a year
    rf"|copyright[ \t:]+(?:by[ \t]+)?(?!(?:{BODY})\b)[^\s0-9]"  # a holder
    rf"|\(c\)[ \t]+(?!(?:{BODY}|the)\b)(?=[^\s]+(?:[ \t]+[^\s]+){{0,4}}[ \t]*$)"  # no item of a list
    r"|all rights reserved"
    rf")[^\n]*?(?=\b(?:{GRANT})|$)"
)

#: What the SQL takes for a claim: any line that begins so.
COPYRIGHT = r"(?m)^[^\n0-9A-Za-z]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


#: Everything but digits, lower-case letters, letters beyond ASCII and line ends.
PUNCTUATION = r"[\x00-\x09\x0b-/:-`{-\x7f‘’“”–—«»©]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text with its line ends; words stand between two blanks each."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), CLAIM, " "), PUNCTUATION, "  ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form or of a line of it, runs of blanks and line ends taken as one blank."""
    return F.sha2(F.btrim(F.regexp_replace(form, "[ \n]+", " ")).cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN, digests=()) -> DataFrame:
    """digest, license for each known text (license, text) and given digest (license, digest); one row per digest."""
    rows = spark.createDataFrame(list(known), "license string, text string").select("license", digest(canonical(F.col("text"))).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, license, n_notices, notices.

    ``digest`` is the SHA-256 of the whole text's canonical form (null for null), ``license`` the known license
    with that digest.  ``n_notices`` counts the lines that are, as a whole, a known text, ``notices`` lists their
    licenses, sorted, comma-joined, without repeats ('' if none).  Texts that are empty in canonical form match
    nothing.  Known texts (digest, license) are a list that the caller bounds.  Repeated rows each get a row.
    """
    known = known if known is not None else known_digests(docs.sparkSession, digests=WHOLE + TERMS)
    form = canonical(F.coalesce(F.col(text), F.lit("")))
    forms = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.col(text).isNull().alias("void"), form.alias("form"))
    parts = F.concat(F.array(digest(F.col("form"))), F.transform(F.split("form", "\n", -1), digest))
    units = forms.select("d", "h", "void", F.posexplode(parts).alias("pos", "digest"))
    whole = F.col("pos") == 0
    met = units.join(F.broadcast(known), "digest", "left").where(whole | F.col("license").isNotNull())
    rows = met.groupBy("d", "h").agg(
        F.max(F.when(whole & ~F.col("void"), F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("license"))).alias("license"),
        F.count_if(whole).alias("copies"),
        F.count_if(~whole).alias("lines"),
        F.array_sort(F.collect_set(F.when(~whole, F.col("license")))).alias("found"),
    )
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("d").alias("doc_id"), "digest", "license", (F.col("lines") / F.col("copies")).cast("long").alias("n_notices"), F.array_join("found", ",").alias("notices"))


def oracle() -> str:
    """DuckDB SQL for :func:`scan` over ``documents`` with the built-in list."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g'), '{PUNCTUATION}', '  ', 'g')"
        out = f"(' ' || replace({out}, chr(10), ' ' || chr(10) || ' ') || ' ')"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return out

    sha = lambda x: f"sha256(trim(regexp_replace({x}, '[ \n]+', ' ', 'g')))"
    given = ", ".join(f"('{name}', '{x}')" for name, x in WHOLE + TERMS)
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT digest, min(name) AS license FROM (
    SELECT name, {sha(form("t"))} AS digest FROM (VALUES {values}) v(name, t) UNION ALL SELECT name, digest FROM (VALUES {given}) g(name, digest)
  ) GROUP BY 1
), forms AS (
  SELECT doc_id, text IS NULL AS void, {form("coalesce(text, '')")} AS form FROM documents
), lines AS (
  SELECT doc_id, {sha("line")} AS digest FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM forms)
), notices AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM lines JOIN known USING (digest) GROUP BY doc_id
)
SELECT f.doc_id, CASE WHEN NOT f.void THEN {sha("f.form")} END AS digest, k.license,
       coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM forms f LEFT JOIN known k ON k.digest = {sha("f.form")} LEFT JOIN notices n ON n.doc_id = f.doc_id
"""
