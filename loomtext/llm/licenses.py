"""License scans by sentence rules, in SQL functions only.

A text is cut into parts (at line ends, and after ``.``, ``!`` or ``?`` before
white space); each is normalised to lower-case words, without comment leaders;
an exact lookup maps a part, or parts that follow each other inside a paragraph
and together are a hard-wrapped sentence, to the identifier of a known licence
sentence.  Bare list numbers, copyright lines and parts without words don't break a sequence.  Known sentences of one
document that stand side by side are an identifier sequence, and the ordered
rules are matched against it: the first rule in order takes all its places, the
next rule sees what is left.

Defined results.  Null and blank texts have no sentence.  One row per sequence
in which a rule matched; a known sentence that no rule takes is reported in
``sentence_ids`` only.  Rows that are equal in id and text are one document;
rows that share an id and differ in text are scanned each for itself.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Known licence sentences, normalised: identifier -> words. Public licence texts.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-ref3": "this project is licensed under the mit license",
    "mit-head": "the mit license mit",
    "mit-head2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-ref2": "licensed under the apache license version 2 0 the license",
    "apache-ref3": "this work is licensed under the apache license version 2 0",
    "apache-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl3-ref2": "licensed under the gnu general public license version 3",
    "gpl2-ref2": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-more": "see the gnu general public license for more details",
    "lgpl3-ref": "licensed under the gnu lesser general public license version 3",
    "agpl3-ref": "licensed under the gnu affero general public license version 3",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-ref": "licensed under the bsd 2 clause license",
    "bsd3-ref": "licensed under the bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0-ref": "licensed under cc0 1 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-nd-ref": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-ref": "licensed under cc by nc sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "reserved": "all rights reserved",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd2-head": "bsd 2 clause license",
    "bsd3-head": "bsd 3 clause license",
    "bsd3-head2": "the 3 clause bsd license",
    "isc-head": "isc license",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-head": "apache license",
    "apache-version": "version 2 0 january 2004",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl-url": "if not see https www gnu org licenses",
    "gpl-url2": "if not see http www gnu org licenses",
    "gpl-head": "gnu general public license",
    "gpl3-version": "version 3 29 june 2007",
    "gpl2-version": "version 2 june 1991",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-more": "see the gnu lesser general public license for more details",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-more": "see the gnu affero general public license for more details",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "boost-head": "boost software license version 1 0 august 17th 2003",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense-any": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "epl2-ref": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl2-url": "which is available at https www eclipse org legal epl 2 0",
}

# Licences that a line "SPDX-License-Identifier: ..." may name. Public identifiers.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
SENTENCES |= {f"spdx-{x}": "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ") for x in SPDX}

# Ordered rules: licence and the sequence of identifiers that shows it; longer evidence comes first.
RULES = [
    ("Apache-2.0", ["apache-ref2", "apache-not", "apache-copy", "apache-url", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-ref2", "apache-not", "apache-copy"]),
    ("Apache-2.0", ["apache-ref2", "apache-not", "apache-copy", "apache-url"]),
    ("Apache-2.0", ["apache-head", "apache-version"]),
    ("MIT", ["mit-head", "mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-head2", "mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-head", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-head2", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-head", "mit-grant"]),
    ("MIT", ["mit-head2", "mit-grant"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("BSD-3-Clause", ["bsd3-head", "reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd2-head", "reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable"]),
    ("BSD-2-Clause", ["reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd3-head", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd3-head2", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd3-head", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd2-head", "bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd2-head", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-more", "gpl-copy", "gpl-url"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-more", "gpl-copy", "gpl-url2"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-more", "gpl-copy", "gpl-url"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-more", "gpl-copy", "gpl-url2"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-more", "agpl-copy", "gpl-url"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-more", "agpl-copy", "gpl-url2"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-more"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope", "lgpl-more"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-more"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("GPL-3.0", ["gpl-head", "gpl3-version"]),
    ("GPL-2.0", ["gpl-head", "gpl2-version"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-more"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-more"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("MPL-2.0", ["mpl2-ref", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("ISC", ["isc-head", "isc-grant", "isc-asis"]),
    ("ISC", ["isc-head", "isc-grant"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-head"]),
    ("Unlicense", ["unlicense", "unlicense-any"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-asis", "zlib-liable"]),
    ("BSL-1.0", ["boost-head"]),
    ("EPL-2.0", ["epl2-ref", "epl2-url"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("BSD-3-Clause", ["bsd3-head"]),
    ("BSD-3-Clause", ["bsd3-head2"]),
    ("BSD-2-Clause", ["bsd2-head"]),
    ("MIT", ["mit-head"]),
    ("MIT", ["mit-head2"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref2"]),
    ("MIT", ["mit-ref3"]),
    ("Apache-2.0", ["apache-ref2"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-ref3"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-3.0", ["gpl3-ref2"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("GPL-2.0", ["gpl2-ref2"]),
    ("LGPL-3.0", ["lgpl3-ref"]),
    ("AGPL-3.0", ["agpl3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    *((x, [f"spdx-{x}"]) for x in SPDX),
    ("proprietary", ["reserved"]),
]

NOT_WORD = r"[^\p{L}\p{N}]+"
NEUTRAL = "^([0-9]{1,3}|[a-z]|copyright (c )?[0-9]{4}( .*)?)$"

MOST_WORDS = max(len(w.split(" ")) for w in SENTENCES.values())
MOST_CHARS = max(map(len, SENTENCES.values()))
FIRST_WORDS = sorted({w.split(" ")[0] for w in SENTENCES.values()})


def lines(text: Column) -> Column:
    """The text cut at line ends and sentence ends; a part after a sentence's end or an empty line begins with 0x02."""
    text = F.translate(text, "\x01\x02", "  ")
    text = F.regexp_replace(text, r"[.!?]+[ \t\r\n]+", "\x01\x02")
    text = F.regexp_replace(text, r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*", "\x01\x02")
    return F.split(F.regexp_replace(text, r"[ \t\r]*\n[ \t\r\n]*", "\x01"), "\x01")


def _placed(part: Column, i: Column) -> Column:
    """(pos, hard, words): no sentence reaches over a hard beginning, nor over a skipped part."""
    hard = F.startswith(part, F.lit("\x02")) | F.coalesce(_skipped(normalised(F.get("lines", i - 1))), F.lit(False))
    return F.struct(i.alias("pos"), hard.alias("hard"), normalised(part).alias("words"))


def _skipped(words: Column) -> Column:
    """Parts without words, such as bare comment leaders, bare list numbers and copyright lines don't break a sequence."""
    return (words == "") | words.rlike(NEUTRAL)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def apply_rules(sequence: Column, rules=RULES) -> Column:
    """A sequence '|a||b|' with every place that a rule takes turned into '<licence>'."""
    for licence, ids in rules:
        sequence = F.replace(sequence, F.lit("".join(f"|{i}|" for i in ids)), F.lit(f"<{licence}>"))
    return sequence


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, first_sentence, n_sentences, sentence_ids, licenses (in order, comma-joined) of each sequence."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(w, i) for i, w in SENTENCES.items()], "sentence string, id string"))  # fixed size
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), lines(text).alias("lines"))
    docs = docs.withColumn("lines", F.filter(F.transform("lines", _placed), lambda x: ~_skipped(x["words"])))
    # a known sentence has at most MOST_WORDS lines; only lines that begin like one are followed
    first = F.transform("lines", lambda x, i: F.struct(i.alias("k"), x["pos"].alias("pos"), F.regexp_replace(x["words"], "^[0-9]{1,3} ", "").alias("words")))
    first = F.filter(first, lambda x: F.substring_index(x["words"], " ", 1).isin(*FIRST_WORDS))
    starts = docs.select("doc_id", "text_hash", F.explode(F.transform(first, lambda x: F.struct(x["k"].alias("k"), x["pos"].alias("pos"), x["words"].alias("words"), F.slice("lines", x["k"] + 2, MOST_WORDS - 1).alias("more")))).alias("s"))
    ends = F.array_position(F.transform("s.more", lambda x: x["hard"]), True)
    more = F.slice("s.more", F.lit(1), F.when(ends > 0, ends - 1).otherwise(F.size("s.more")).cast("int"))
    grown = F.transform(F.sequence(F.lit(0), F.size("more")), lambda m: F.struct((m + 1).alias("n"), F.array_join(F.concat(F.array("words"), F.transform(F.slice("more", F.lit(1), m), lambda x: x["words"])), " ").alias("sentence")))
    each = starts.select("doc_id", "text_hash", "s.k", "s.pos", "s.words", more.alias("more")).select("doc_id", "text_hash", "k", "pos", F.inline(grown))
    hits = each.where(F.length("sentence") <= MOST_CHARS).join(known, "sentence").select("doc_id", "text_hash", "k", "pos", "n", "id").distinct()
    # of sentences that overlap the first stays, then the longest
    held = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("k", (-F.col("n")).alias("less"), "pos", "id"))).alias("hits"))
    none = F.filter("hits", lambda x: F.lit(False))
    held = held.select("doc_id", "text_hash", F.inline(F.aggregate("hits", none, lambda kept, x: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["k"] - F.element_at(kept, -1)["less"] <= x["k"]), F.concat(kept, F.array(x))).otherwise(kept))))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hits = held.withColumn("run", F.col("k") + F.coalesce(F.sum("less").over(order), F.lit(0)))
    runs = hits.groupBy("doc_id", "text_hash", "run").agg(F.min("pos").alias("first"), F.count("*").alias("n_sentences"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ids"))
    ids = F.transform("ids", lambda x: x["id"])
    matched = apply_rules(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")))
    runs = runs.select("doc_id", F.col("first").cast("long").alias("first_sentence"), F.col("n_sentences").cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join(F.regexp_extract_all(matched, F.lit("<([^>]*)>"), 1), ",").alias("licenses"))
    return runs.where("licenses <> ''")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The scan by lists of parts and their joined runs; of sentences that overlap the first and longest stays."""
    known = ", ".join(f"('{w}', '{i}')" for i, w in SENTENCES.items())
    firsts = ", ".join(f"'{w}'" for w in FIRST_WORDS)
    folded = "'|' || string_agg(id, '||' ORDER BY pos) || '|'"
    for licence, ids in RULES:
        folded = f"replace({folded}, '{''.join(f'|{i}|' for i in ids)}', '<{licence}>')"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), s AS (
  SELECT row_number() OVER () AS d, doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '[.!?]+[ 	
]+', chr(1) || chr(2), 'g'), '[ 	
]*
[ 	
]*
[ 	
]*', chr(1) || chr(2), 'g'), '[ 	
]*
[ 	
]*', chr(1), 'g'), chr(1)) AS x
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), e AS (
  SELECT d, doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS raw FROM s
), w AS (
  SELECT d, doc_id, pos, starts_with(raw, chr(2)) AS begins, trim(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words FROM e
), n AS (
  SELECT *, words = '' OR regexp_matches(words, '{NEUTRAL}') AS neutral FROM w
), p AS (
  SELECT *, begins OR coalesce(lag(neutral) OVER (PARTITION BY d ORDER BY pos), false) AS hard FROM n
), k AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY pos) AS k, sum(CASE WHEN hard THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY pos) AS part FROM p WHERE NOT neutral
), l AS (
  SELECT d, part, list(words ORDER BY k) AS lines FROM k GROUP BY 1, 2
), a AS (
  SELECT k.*, regexp_replace(words, '^[0-9]{{1,3}} ', '') AS head, lines[k - (min(k) OVER (PARTITION BY d, part)) + 2:k - (min(k) OVER (PARTITION BY d, part)) + {MOST_WORDS}] AS more FROM k JOIN l USING (d, part)
), g AS (
  SELECT d, doc_id, pos, k, head, more, unnest(range(0, len(more) + 1)) AS m FROM a WHERE split_part(head, ' ', 1) IN ({firsts})
), t AS (
  SELECT d, doc_id, pos, k, m + 1 AS n, array_to_string(list_prepend(head, more[1:m]), ' ') AS sentence FROM g
), h AS (
  SELECT d, doc_id, pos, k, max(n) AS n, max_by(id, n) AS id FROM t JOIN known USING (sentence) GROUP BY ALL
), f AS (
  SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.d = h.d AND o.k < h.k AND o.k + o.n > h.k)
), r AS (
  SELECT *, k - coalesce(sum(n) OVER (PARTITION BY d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f
), m AS (
  SELECT doc_id, min(pos) AS first_sentence, count(*) AS n_sentences, string_agg(id, ',' ORDER BY pos) AS sentence_ids, {folded} AS f
  FROM r GROUP BY d, doc_id, run
)
SELECT doc_id, CAST(first_sentence AS BIGINT) AS first_sentence, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids,
       array_to_string(regexp_extract_all(f, '<([^>]*)>', 1), ',') AS licenses
FROM m WHERE len(regexp_extract_all(f, '<([^>]*)>', 1)) > 0
"""


OP4_SQL = _sql()
