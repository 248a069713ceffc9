"""License recognition by sentence rules.

A text is cut into sentences; each is normalised and mapped to the identifier of a known licence sentence. The
sequence of identifiers is then matched against ordered licence rules: a rule that finds its sequence names its
licence and uses the sentences up, so that later, shorter rules do not see them.
Only SQL functions are used, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

#: (identifier, pattern of the whole normalised sentence), first match wins. Normalised: lower case, comment marks
#: and punctuation other than . - + / ( ) and commas removed, blanks single. Patterns work in Java and RE2 alike.
SENTENCES = (
    ("spdx_mit", r"spdx-license-identifier (mit)"),
    ("spdx_apache2", r"spdx-license-identifier (apache-2\.0)"),
    ("spdx_bsd3", r"spdx-license-identifier (bsd-3-clause)"),
    ("spdx_bsd2", r"spdx-license-identifier (bsd-2-clause)"),
    ("spdx_gpl2", r"spdx-license-identifier (gpl-2\.0)(-only|-or-later|\+)?"),
    ("spdx_gpl3", r"spdx-license-identifier (gpl-3\.0)(-only|-or-later|\+)?"),
    ("spdx_mpl2", r"spdx-license-identifier (mpl-2\.0)"),
    ("mit_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?mit licen[cs]e( \(mit\))?"),
    ("mit_title", r"(the )?mit licen[cs]e( \(mit\))?"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_warranty", r"the software is provided as is without warranty of any kind .*"),
    ("apache2_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?apache licen[cs]e version 2\.0( \(the license\))?"),
    ("apache2_title", r"apache licen[cs]e( version 2\.0)?( january 2004)?"),
    ("apache2_use", r"you may not use this file except in compliance with the license"),
    ("apache2_copy", r"you may obtain a copy of the license at( .*)?"),
    ("apache2_law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("apache2_see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice .*"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse or promote products .*"),
    ("bsd_warranty", r"this software is provided by .* as is and any express or implied warranties .*"),
    ("bsd_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?([23]-clause )?bsd licen[cs]e"),
    ("lgpl_by", r"(this (work|file|software|project|code|library) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?gnu lesser general public licen[cs]e( version [0-9.]+)?( or (any )?later)?"),
    ("agpl_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?gnu affero general public licen[cs]e( version [0-9.]+)?( or (any )?later)?"),
    ("gpl3_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?gnu general public licen[cs]e version 3(\.0)?( or (any )?later)?"),
    ("gpl2_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?gnu general public licen[cs]e version 2(\.0)?( or (any )?later)?"),
    ("gpl_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?gnu general public licen[cs]e"),
    ("gpl3_free", r"this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 .*"),
    ("lgpl_free", r"this (program|library) is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license .*"),
    ("agpl_free", r"this program is free software you can redistribute it and/or modify it under the terms of the gnu affero general public license .*"),
    ("free", r"this (program|library) is free software"),
    ("gpl_terms", r"you can redistribute it and/or modify it under the terms of the gnu general public license( as published by the free software foundation)?"),
    ("lgpl_terms", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public license( as published by the free software foundation)?"),
    ("agpl_terms", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license( as published by the free software foundation)?"),
    ("version2", r"either version 2(\.1)? of the license or( \(at your option\))? any later version"),
    ("version3", r"either version 3 of the license or( \(at your option\))? any later version"),
    ("gpl_free", r"this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license .*"),
    ("gpl_hope", r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl_received", r"you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library).*"),
    ("mpl2_by", r"this source code form is subject to the terms of the mozilla public license( v(\.? ?2\.0)?)?"),
    ("mpl2_copy", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("isc_grant", r"permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted .*"),
    ("cc0_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?cc0( 1\.0)?( universal)?"),
    ("ccbync_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?(cc by-nc|creative commons attribution-noncommercial)( [0-9.]+)?( (international )?license)?"),
    ("ccbysa_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?(cc by-sa|creative commons attribution-sharealike)( [0-9.]+)?( (international )?license)?"),
    ("ccby_by", r"(this (work|file|software|project|code) is )?(released|licensed|distributed|available|provided) under (the )?(terms of (the )?)?(cc by|creative commons attribution)( [0-9.]+)?( (international )?license)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public_domain", r"(this (work|file|software|project|code) )?(is )?(released|dedicated|placed) (in|to|into) the public domain"),
    ("reserved", r"all rights reserved"),
    ("copyright", r"copyright (\(c\) )?.*"),
)

#: (licence, sentence identifiers in order); earlier rules go first.
RULES = (
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_by",)),
    ("MIT", ("spdx_mit",)),
    ("MIT", ("mit_title",)),
    ("Apache-2.0", ("apache2_by", "apache2_use", "apache2_copy", "apache2_law", "apache2_see")),
    ("Apache-2.0", ("apache2_by",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("Apache-2.0", ("apache2_title",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty")),
    ("BSD", ("bsd_by",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD", ("bsd_grant",)),
    ("GPL-3.0", ("gpl3_free", "gpl_hope", "gpl_received")),
    ("GPL-3.0", ("gpl3_free",)),
    ("GPL-2.0", ("free", "gpl_terms", "version2", "gpl_hope", "gpl_received")),
    ("GPL-2.0", ("free", "gpl_terms", "version2")),
    ("GPL-3.0", ("free", "gpl_terms", "version3")),
    ("LGPL", ("lgpl_free", "gpl_hope", "gpl_received")),
    ("LGPL", ("lgpl_free",)),
    ("LGPL", ("free", "lgpl_terms")),
    ("AGPL", ("agpl_free", "gpl_hope", "gpl_received")),
    ("AGPL", ("agpl_free",)),
    ("AGPL", ("free", "agpl_terms")),
    ("GPL", ("gpl_free", "gpl_hope", "gpl_received")),
    ("GPL", ("gpl_free",)),
    ("GPL-3.0", ("gpl3_by",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-2.0", ("gpl2_by",)),
    ("GPL-2.0", ("spdx_gpl2",)),
    ("GPL", ("gpl_by",)),
    ("LGPL", ("lgpl_by",)),
    ("AGPL", ("agpl_by",)),
    ("MPL-2.0", ("mpl2_by", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_by",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("ISC", ("isc_grant", "mit_warranty")),
    ("ISC", ("isc_grant",)),
    ("CC0-1.0", ("cc0_by",)),
    ("CC-BY-NC", ("ccbync_by",)),
    ("CC-BY-SA", ("ccbysa_by",)),
    ("CC-BY", ("ccby_by",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public_domain",)),
    ("All-Rights-Reserved", ("copyright", "reserved")),
    ("All-Rights-Reserved", ("reserved",)),
)

#: Every known sentence has one of these; other sentences are not looked at further.
HINT = r"licen[cs]e|copyright|permission|redistribut|warrant|public domain|rights reserved|cc0|creative commons|under cc |software|endorse|mpl"
#: As HINT, but for all ways to word a known sentence.
SENTENCE_HINT = HINT + r"|under (?:the )?(?:terms of (?:the )?)?cc "
#: Every text with a known sentence has one of these words, in any case and wherever its lines break.
WORD_HINT = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|public|reserved|cc0|commons|\bcc\b|software|endorse|mpl"
#: Within a sentence that is not known as a whole, a line end before a capital letter ends one: it is marked, and cut.
CAPITAL = r"\n[\x20\x09-\x0D]*([A-Z])"
MARK = "\x01"
#: Sentences that may run over lines with capitals, as one pattern; a copyright line is never continued.
WRAPPED = "|".join(f"(?:{p})" for name, p in SENTENCES if name not in ("copyright", "reserved"))
#: Sentences end at . ! ? or ; before a blank, and at blank lines.
CUT = r"[.!?;][\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"


def sentences(text: Column | str) -> Column:
    """The normalised sentences of a text that may be licence sentences, as array<struct<pos, sentence, raw>>.

    ``pos`` is the sentence's place among all sentences of the text. Null and empty texts have none.
    """
    text = F.col(text) if isinstance(text, str) else text
    hinted = F.when(text.rlike(WORD_HINT), F.split(text, CUT)).otherwise(F.expr("cast(array() as array<string>)"))
    whole = lambda s: F.contains(s, F.lit("\n")) & s.rlike(WORD_HINT) & normalize(s).rlike(f"^(?:{WRAPPED})$")
    pieces = lambda s: F.split(F.regexp_replace(s, CAPITAL, f"{MARK}$1"), MARK)
    hinted = F.flatten(F.transform(hinted, lambda s: F.when(whole(s), F.array(s)).otherwise(pieces(s))))
    numbered = F.transform(hinted, lambda s, i: F.struct(i.cast("long").alias("pos"), normalize(s).alias("sentence"), s.alias("raw")))
    return F.filter(numbered, lambda s: s["sentence"].rlike(SENTENCE_HINT))


def normalize(s: Column) -> Column:
    """Lower case; comment marks and most punctuation removed; blanks single, none inside brackets; no final stop."""
    plain = F.regexp_replace(F.lower(s), r"[^a-z0-9.()+/-]+", " ")
    bare = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r" [-*/+.#]+ ", " ")
    bare = F.replace(F.replace(bare, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))
    return F.regexp_replace(bare, r"^[ .]+|[ .]+$", "")



def identify(sentence: Column) -> Column:
    """The identifier of a normalised sentence; null if it is not known."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Add ``license_scan`` to each row of ``docs`` (from ``text``), keeping all other columns.

    A struct: ``found`` (array of pos, sentence, raw, id: the known sentences in order, as normalised and as they
    stand in the text), ``licenses`` (names by rule order, each once), ``unused`` (identifiers no rule took).
    Null, empty and licence-free texts have empty arrays. Repeated rows get equal results; texts of any
    length are scanned whole; an own column license_scan is replaced, all others are kept.
    """
    docs = docs.drop("license_scan")
    known_, matched_ = fresh(docs, "_known"), fresh(docs, "_matched")
    named = F.transform(sentences("text"), lambda s: F.struct(s["pos"].alias("pos"), s["sentence"].alias("sentence"), s["raw"].alias("raw"), identify(s["sentence"]).alias("id")))
    known = F.coalesce(F.filter(named, lambda s: s["id"].isNotNull()), F.expr("cast(array() as array<struct<pos:bigint,sentence:string,raw:string,id:string>>)"))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES])
    start = F.struct(F.array_join(F.transform(F.col(known_), lambda s: F.concat(F.lit("<"), s["id"], F.lit(">"))), "").alias("rest"), F.expr("cast(array() as array<string>)").alias("licenses"))

    def step(acc, rule):
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(
            F.replace(acc["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(hit, F.array_union(acc["licenses"], F.array(rule["license"]))).otherwise(acc["licenses"]).alias("licenses"),
        )

    matched = F.when(F.size(known_) > 0, F.aggregate(rules, start, step)).otherwise(start)
    out = docs.withColumn(known_, known).withColumn(matched_, matched)
    return out.select(*docs.columns, F.struct(F.col(known_).alias("found"), F.col(f"{matched_}.licenses").alias("licenses"), F.regexp_extract_all(F.col(f"{matched_}.rest"), F.lit("<([a-z0-9_]+)>"), F.lit(1)).alias("unused")).alias("license_scan"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, n_sentences (known ones), sentence_ids, positions, licenses, unused."""
    found = scan(docs.select("doc_id", "text"))
    s = "license_scan"
    return found.select(
        "doc_id",
        F.size(f"{s}.found").cast("long").alias("n_sentences"),
        F.array_join(f"{s}.found.id", ",").alias("sentence_ids"),
        F.array_join(F.transform(f"{s}.found.pos", lambda p: p.cast("string")), ",").alias("positions"),
        F.array_join(f"{s}.licenses", ",").alias("licenses"),
        F.array_join(f"{s}.unused", ",").alias("unused"),
    )
