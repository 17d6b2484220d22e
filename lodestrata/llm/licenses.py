"""License recognition by sentences and ordered rules, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence texts and notices, by identifier. Words
#: are runs of a-z and 0-9 in lower case; ``*`` stands for one to eight words.
SENTENCES = {
    "MIT_TITLE": ("mit license", "the mit license", "the mit license mit", "license mit", "spdx license identifier mit"),
    "MIT_REF": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "this software is released under the mit license"),
    "MIT_GRANT": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MIT_NOTICE": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "MIT_AS_IS": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "MIT_LIABILITY": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "APACHE2_TITLE": ("apache license version 2 0 january 2004 http www apache org licenses", "spdx license identifier apache 2 0"),
    "APACHE2_TERMS": ("terms and conditions for use reproduction and distribution",),
    "APACHE2_COPYRIGHT_GRANT": ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",),
    "APACHE2_REDISTRIBUTION": ("you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions",),
    "APACHE2_TRADEMARKS": ("this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file",),
    "APACHE2_REF": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0", "released under the apache license version 2 0"),
    "APACHE2_COMPLY": ("you may not use this file except in compliance with the license",),
    "APACHE2_URL": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "APACHE2_AS_IS": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "APACHE2_SEE": ("see the license for the specific language governing permissions and limitations under the license",),
    "GPL3_TITLE": ("gnu general public license version 3 29 june 2007", "spdx license identifier gpl 3 0 only"),
    "GPL2_TITLE": ("gnu general public license version 2 june 1991", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0 only"),
    "LGPL3_TITLE": ("gnu lesser general public license version 3 29 june 2007",),
    "LGPL21_TITLE": ("gnu lesser general public license version 2 1 february 1999",),
    "AGPL3_TITLE": ("gnu affero general public license version 3 19 november 2007",),
    "GNU_VERBATIM": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "GPL_FREE_COPYLEFT": ("the gnu general public license is a free copyleft license for software and other kinds of works",),
    "AGPL_FREE_COPYLEFT": ("the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",),
    "GPL2_PREAMBLE": ("the licenses for most software are designed to take away your freedom to share and change it",),
    "LGPL3_INCORPORATES": ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",),
    "GPL3_REF": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu general public license v3 0", "released under the gnu general public license version 3"),
    "GPL2_REF": ("licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "released under the gnu general public license version 2"),
    "GPL3_PLUS_GRANT": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier gpl 3 0 or later"),
    "GPL2_PLUS_GRANT": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "spdx license identifier gpl 2 0 or later"),
    "GPL2_ONLY_GRANT": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",),
    "GPL_WARRANTY": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "GPL_SEE": ("see the gnu general public license for more details",),
    "GPL_COPY": ("you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    "LGPL21_PLUS_GRANT": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "LGPL3_PLUS_GRANT": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "LGPL_WARRANTY": ("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "LGPL_SEE": ("see the gnu lesser general public license for more details",),
    "AGPL3_PLUS_GRANT": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier agpl 3 0 or later"),
    "AGPL_SEE": ("see the gnu affero general public license for more details",),
    "CC_BY_NC_4_REF": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CC_BY_4_REF": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "CC_BY_SA_4_REF": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "CC0_REF": ("licensed under cc0 1 0", "cc0 1 0 universal", "to the extent possible under law * has waived all copyright and related or neighboring rights to this work"),
    "BSD_GRANT": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BSD_SOURCE": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BSD_BINARY": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BSD_ADVERTISING": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "BSD_ENDORSE": ("neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "BSD_AS_IS": ("this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "BSD_LIABILITY": ("in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "ISC_GRANT": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD_GRANT": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "ISC_AS_IS": ("the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the software is provided as is and * disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    "ISC_LIABILITY": ("in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "UNLICENSE": ("this is free and unencumbered software released into the public domain",),
    "UNLICENSE_GRANT": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "MPL2_TITLE": ("mozilla public license version 2 0",),
    "MPL2_REF": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "MPL2_COPY": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "BSL1_GRANT": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "BSL1_REF": ("distributed under the boost software license version 1 0",),
    "ZLIB_AS_IS": ("this software is provided as is without any express or implied warranty",),
    "ZLIB_GRANT": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "WTFPL": ("do what the fuck you want to public license",),
}

#: Ordered: a rule takes its run of identifiers out of the sequence before the next rule looks at it.
RULES = [
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABILITY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY", "APACHE2_URL", "APACHE2_AS_IS", "APACHE2_SEE")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY", "APACHE2_AS_IS", "APACHE2_SEE")),
    ("Apache-2.0", ("APACHE2_TERMS", "APACHE2_COPYRIGHT_GRANT", "APACHE2_REDISTRIBUTION", "APACHE2_TRADEMARKS")),
    ("LGPL-3.0", ("LGPL3_TITLE", "GNU_VERBATIM", "LGPL3_INCORPORATES")),
    ("AGPL-3.0", ("AGPL3_TITLE", "GNU_VERBATIM", "AGPL_FREE_COPYLEFT")),
    ("GPL-3.0", ("GPL3_TITLE", "GNU_VERBATIM", "GPL_FREE_COPYLEFT")),
    ("GPL-2.0", ("GPL2_TITLE", "GNU_VERBATIM", "GPL2_PREAMBLE")),
    ("LGPL-2.1", ("LGPL21_TITLE", "GNU_VERBATIM")),
    ("GPL-3.0-or-later", ("GPL3_PLUS_GRANT", "GPL_WARRANTY", "GPL_SEE")),
    ("GPL-2.0-or-later", ("GPL2_PLUS_GRANT", "GPL_WARRANTY", "GPL_SEE")),
    ("GPL-2.0-only", ("GPL2_ONLY_GRANT", "GPL_WARRANTY", "GPL_SEE")),
    ("LGPL-2.1-or-later", ("LGPL21_PLUS_GRANT", "LGPL_WARRANTY", "LGPL_SEE")),
    ("LGPL-3.0-or-later", ("LGPL3_PLUS_GRANT", "LGPL_WARRANTY", "LGPL_SEE")),
    ("LGPL-3.0-or-later", ("LGPL3_PLUS_GRANT", "GPL_WARRANTY", "LGPL_SEE")),
    ("AGPL-3.0-or-later", ("AGPL3_PLUS_GRANT", "GPL_WARRANTY", "AGPL_SEE")),
    ("BSD-4-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISING", "BSD_ENDORSE")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("ISC", ("ISC_GRANT", "ISC_AS_IS", "ISC_LIABILITY")),
    ("ISC", ("ISC_GRANT",)),
    ("0BSD", ("0BSD_GRANT", "ISC_AS_IS", "ISC_LIABILITY")),
    ("MPL-2.0", ("MPL2_REF", "MPL2_COPY")),
    ("Zlib", ("ZLIB_AS_IS", "ZLIB_GRANT")),
    ("GPL-3.0-or-later", ("GPL3_PLUS_GRANT",)),
    ("GPL-2.0-or-later", ("GPL2_PLUS_GRANT",)),
    ("GPL-2.0-only", ("GPL2_ONLY_GRANT",)),
    ("LGPL-2.1-or-later", ("LGPL21_PLUS_GRANT",)),
    ("LGPL-3.0-or-later", ("LGPL3_PLUS_GRANT",)),
    ("AGPL-3.0-or-later", ("AGPL3_PLUS_GRANT",)),
    ("MIT", ("MIT_REF",)),
    ("MIT", ("MIT_TITLE",)),
    ("MIT", ("MIT_GRANT",)),
    ("Apache-2.0", ("APACHE2_REF",)),
    ("Apache-2.0", ("APACHE2_TITLE",)),
    ("GPL-3.0-only", ("GPL3_REF",)),
    ("GPL-2.0-only", ("GPL2_REF",)),
    ("GPL-3.0", ("GPL3_TITLE",)),
    ("GPL-2.0", ("GPL2_TITLE",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_4_REF",)),
    ("CC-BY-4.0", ("CC_BY_4_REF",)),
    ("CC0-1.0", ("CC0_REF",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("MPL-2.0", ("MPL2_TITLE",)),
    ("Unlicense", ("UNLICENSE",)),
    ("BSL-1.0", ("BSL1_GRANT",)),
    ("BSL-1.0", ("BSL1_REF",)),
    ("WTFPL", ("WTFPL",)),
]

#: Between two words of a sentence: a space, or the marks that ends of lines and of sentences leave.
_GAP = "[ \\n|]+"
_SLOT = f"[a-z0-9]+(?:{_GAP}[a-z0-9]+){{0,7}}"
#: How a text in lower case becomes words and marks, step by step: pattern and replacement. Marks are double, so that
#: two sentences in a row have one each. Both engines read these patterns alike.
_STEPS = [("\\|", " "), ("[.!?:;]+([^a-z0-9.!?:;]|$)", "||\\1"), ("[^a-z0-9\\n|]+", " "), ("\\n", "\n\n")]


def _pattern(sentence: str, gap: str = _GAP) -> str:
    return gap.join(_SLOT.replace(_GAP, gap) if w == "*" else w for w in sentence.split())


def _any(sentences: dict[str, tuple[str, ...]]) -> str:
    """One pattern for all sentences between two marks, the longest first."""
    every = sorted({s for group in sentences.values() for s in group}, key=lambda s: (-len(s), s))
    return "(?:^|[\\n|]) *(" + "|".join(map(_pattern, every)) + ") *(?:[\\n|]|$)"


def _slots(sentences: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """For each sentence with a slot, the pattern of what may stand there and the sentence as the table has it."""
    return [(f"^{_pattern(s, ' ')}$", s) for group in sentences.values() for s in group if "*" in s]


def known_sentences(text: Column, sentences: dict[str, tuple[str, ...]] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in their order: array of string.

    A text becomes words of a-z and 0-9. A sentence starts and ends at a line's
    end, or at . ! ? : or ; before anything but a word; inside, it may run over
    any of these, so that wrapped lines, comment marks, blank lines and
    abbreviations don't break it. What is found is mapped to its identifier by
    the fixed table.
    """
    plain = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in _STEPS:
        plain = F.regexp_replace(plain, pattern, by.replace("\\1", "$1"))
    found = F.transform(F.regexp_extract_all(plain, F.lit(_any(sentences)), F.lit(1)), lambda s: F.regexp_replace(s, _GAP, " "))
    slots = _slots(sentences)
    if slots:

        def filled(s):
            out = s
            for pattern, sentence in slots:
                out = F.when(s.rlike(pattern), F.lit(sentence)).otherwise(out)
            return out

        found = F.transform(found, filled)
    names = F.create_map(*[F.lit(x) for name, group in sentences.items() for s in group for x in (s, name)])
    return F.transform(found, lambda s: F.element_at(names, s))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, tuple[str, ...]] = SENTENCES, rules=RULES) -> DataFrame:
    """Licences of each row: doc_id, n_sentences (known ones), sentence_ids, licenses, unmatched.

    One pass over the rows, without a shuffle or Python: known sentences are
    found and looked up in the fixed table, then the sequence of identifiers
    runs through the ordered rules. A text of any length is scanned whole. ``licenses`` lists each found licence once, in the rules'
    order; identifiers that no rule takes stay in ``unmatched``. All are joined
    by commas and empty for texts without a known sentence, null texts
    included. Ids may be null or repeat: each row gives one row. Further
    columns are ignored.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(","), F.concat_ws(",,", known_sentences(F.col(text_col), sentences)), F.lit(",")).alias("s0"))
    found = []
    for k, (name, run) in enumerate(rules):
        want = "," + ",,".join(run) + ","
        out = out.withColumn(f"s{k + 1}", F.when(F.col(f"s{k}") == ",,", F.col(f"s{k}")).otherwise(F.replace(F.col(f"s{k}"), F.lit(want), F.lit(""))))
        found.append(F.when(F.length(f"s{k + 1}") < F.length(f"s{k}"), F.lit(name)))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, "^,+|,+$", ""), ",+", ",")
    ids = tidy(F.col("s0"))
    return out.select("doc_id", F.when(ids == "", F.lit(0)).otherwise(F.size(F.split(ids, ","))).cast("long").alias("n_sentences"), ids.alias("sentence_ids"), F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*found)))).alias("licenses"), tidy(F.col(f"s{len(rules)}")).alias("unmatched"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_sql() -> str:
    quoted = lambda t: t.replace("'", "''")
    names = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, group in SENTENCES.items() for s in group) + "}"
    plain = "lower(coalesce(text, ''))"
    for pattern, by in _STEPS:
        plain = f"regexp_replace({plain}, '{quoted(pattern)}', '{by}', 'g')"
    slot = "x"
    for pattern, sentence in _slots(SENTENCES):
        slot = f"CASE WHEN regexp_matches(x, '{pattern}') THEN '{sentence}' ELSE {slot} END"
    steps, source = [], "s"
    for k, (_, run) in enumerate(RULES):
        want = "," + ",,".join(run) + ","
        steps.append(f"r{k + 1} AS (SELECT *, replace(s{k}, '{want}', '') AS s{k + 1} FROM {source})")
        source = f"r{k + 1}"
    found = ", ".join(f"CASE WHEN length(s{k + 1}) < length(s{k}) THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    return f"""
WITH t AS (
  SELECT doc_id, list_transform(list_transform(regexp_extract_all({plain}, '{_any(SENTENCES)}', 1), lambda y: regexp_replace(y, '{_GAP}', ' ', 'g')), lambda x: {slot}) AS parts
  FROM documents),
s AS (
  SELECT doc_id, ',' || coalesce(array_to_string(list_transform(parts, lambda x: {names}[x]), ',,'), '') || ',' AS s0
  FROM t),
{", ".join(steps)},
f AS (
  SELECT doc_id, regexp_replace(regexp_replace(s0, '^,+|,+$', '', 'g'), ',+', ',', 'g') AS sentence_ids,
         list_filter([{found}], lambda x: x IS NOT NULL) AS found,
         regexp_replace(regexp_replace(s{len(RULES)}, '^,+|,+$', '', 'g'), ',+', ',', 'g') AS unmatched
  FROM {source})
SELECT doc_id, CAST(CASE WHEN sentence_ids = '' THEN 0 ELSE len(string_split(sentence_ids, ',')) END AS BIGINT) AS n_sentences, sentence_ids,
       coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses, unmatched
FROM f"""
