"""What a document says of where it comes from: publisher, issuer, author and other provenance lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many characters of a text's head and tail are read, and the lines looked for, case aside.
HEAD = TAIL = 2500
VALUE_CHARS = 200
PATTERNS = {
    "EXPLICIT_PUBLISHER_LINE": r"(?:published\s+by|publisher|herausgegeben\s+von|herausgeber|[ée]diteur|publi[ée]\s+par|publicado\s+por|editado\s+por|pubblicato\s+da)\s*[:\-]?\s*([^\n|]{3,120})",
    "EXPLICIT_ISSUER_LINE": r"(?:issued\s+by|issuing\s+authority|erlassen\s+von|[ée]mis\s+par|emitido\s+por|emesso\s+da)\s*[:\-]?\s*([^\n|]{3,120})",
    "EXPLICIT_AUTHOR_LINE": r"(?:^|\n)\s*(?:by|von|par|por|di)\s+([A-ZÀ-Ý][\w.À-ÿ'-]+(?:\s+[A-ZÀ-Ý][\w.À-ÿ'-]+){0,3})\s*(?:\n|$)",
    "EXPLICIT_EDITOR_LINE": r"(?:edited\s+by|editor|redaktion|r[ée]dacteur|editado\s+por)\s*[:\-]?\s*([^\n|]{3,120})",
    "EXPLICIT_SUBMISSION_LINE": r"(?:submitted\s+by|uploaded\s+by|deposited\s+by|eingereicht\s+von|soumis\s+par|presentado\s+por)\s*[:\-]?\s*([^\n|]{3,120})",
    "COPYRIGHT_HOLDER": r"(?:©|\(c\)|copyright)\s*(?:\d{4}\s*[-–]?\s*\d{0,4})?\s*([^\n|]{3,100})",
    "TRANSLATION_NOTICE": r"(?:translated\s+by|translation\s+of|[üu]bersetzt\s+von|[üu]bersetzung\s+von|traduit\s+par|traduction\s+de|traducido\s+por|tradotto\s+da)\s*[:\-]?\s*([^\n|]{0,120})",
    "SYNDICATION_NOTICE": r"(?:syndicated\s+(?:by|from)|via\s+(?:reuters|afp|dpa|ap|efe|ansa|pa\s+media)|wire\s+service)\s*[:\-]?\s*([^\n|]{0,120})",
    "MIRROR_NOTICE": r"(?:mirror(?:ed)?\s+(?:of|from|site)|spiegelserver|miroir\s+de|espejo\s+de)\s*[:\-]?\s*([^\n|]{0,120})",
    "ARCHIVE_PROVIDER": r"(?:the\s+wayback\s+machine|archived\s+by|archive-it|internet\s+archive|archiviert\s+von|archiv[ée]\s+par)\s*[:\-]?\s*([^\n|]{0,120})",
    "COMMISSIONING_NOTICE": r"(?:commissioned\s+by|prepared\s+for|study\s+for|im\s+auftrag\s+von|command[ée]\s+par|encargado\s+por)\s*[:\-]?\s*([^\n|]{3,120})",
    "OPERATING_ENTITY_NOTICE": r"(?:operated\s+by|managed\s+by|betrieben\s+von|exploit[ée]\s+par|gestionado\s+por)\s*[:\-]?\s*([^\n|]{3,120})",
    "OWNERSHIP_RECORD": r"(?:owned\s+by|a\s+(?:subsidiary|division)\s+of|eigent[üu]mer|propri[ée]t[ée]\s+de|propiedad\s+de)\s*[:\-]?\s*([^\n|]{3,120})",
    "DOCUMENT_SERIES_OWNER": r"(?:official\s+journal|amtsblatt|journal\s+officiel|diario\s+oficial|gazzetta\s+ufficiale)\s*(?:of|der|de|du|dell[ao])?\s*([^\n|]{0,90})",
    "REVISION_STATEMENT": r"((?:this\s+\w+\s+)?(?:revises|replaces|supersedes|amends|corrects|withdraws|retracts|consolidates)\s+[^\n.]{3,160})",
    "DOCUMENT_IDENTIFIER": r"\b((?:SIB|AD|CELEX|ELI|COM|SWD|JOIN|C|L)\s?(?:No\.?\s?)?[\d./–-]{3,24})\b",
    "PUBLICATION_DATE": r"(?:published|issued|adopted|of)\s+(?:on\s+)?(\d{1,2}\s+\w+\s+(?:19|20)\d\d)",
    "CONTACT_BLOCK": r"((?:for\s+more\s+information,?\s+contact|press\s+office|pressestelle|contact\s+presse)[^\n]{0,120})",
}
EDGES = " .,;:|-–—"
#: Of each type, words of which a match holds one, in lower case: a type's pattern is tried where one of them stands. A
#: pattern without words of its own is tried where ``NEEDS`` is met, or everywhere.
WORDS = {
    "EXPLICIT_PUBLISHER_LINE": ("publi", "pubblicato", "herausge", "diteur", "editado"),
    "EXPLICIT_ISSUER_LINE": ("issued", "issuing", "erlassen", "mis", "emitido", "emesso"),
    "EXPLICIT_EDITOR_LINE": ("edit", "redaktion", "dacteur"),
    "EXPLICIT_SUBMISSION_LINE": ("submitted", "uploaded", "deposited", "eingereicht", "soumis", "presentado"),
    "COPYRIGHT_HOLDER": ("©", "(c)", "copyright"),
    "TRANSLATION_NOTICE": ("translat", "bersetz", "tradu", "tradotto"),
    "SYNDICATION_NOTICE": ("syndicated", "reuters", "afp", "dpa", "via", "wire"),
    "MIRROR_NOTICE": ("mirror", "spiegelserver", "miroir", "espejo"),
    "ARCHIVE_PROVIDER": ("wayback", "archiv"),
    "COMMISSIONING_NOTICE": ("commissioned", "prepared", "study", "auftrag", "command", "encargado"),
    "OPERATING_ENTITY_NOTICE": ("operated", "managed", "betrieben", "exploit", "gestionado"),
    "OWNERSHIP_RECORD": ("owned", "subsidiary", "division", "eigent", "propri", "propiedad"),
    "DOCUMENT_SERIES_OWNER": ("official", "amtsblatt", "officiel", "oficial", "ufficiale"),
    "REVISION_STATEMENT": ("revises", "replaces", "supersedes", "amends", "corrects", "withdraws", "retracts", "consolidates"),
    "PUBLICATION_DATE": ("19", "20"),
    "CONTACT_BLOCK": ("information", "press"),
}
NEEDS = {"DOCUMENT_IDENTIFIER": r"(?U)[\d./–-]{3}"}
#: Letters that count as others where case is set aside, though lower case leaves them as they are.
_SAME = ("ſıİ\u212a", "siik")


def captured(rows: DataFrame, key: str, text: str, everywhere: bool = False) -> DataFrame:
    """key, type, value: the first line of each type in the head and tail of a text, white space and marks at its ends aside.

    Null and empty texts have none. One pass of built-in expressions over the rows: plain searches for a type's words come
    before its pattern, which few texts then need; ``everywhere`` tries all patterns on all texts, with the same result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    tail = F.when(F.length(whole) > HEAD + TAIL, F.concat(F.lit("\n"), F.substring(whole, -TAIL, TAIL))).otherwise("")
    read = rows.select(key, F.concat(F.substring(whole, 1, HEAD), tail).alias("_window")).withColumn("_plain", F.lower(F.translate("_window", *_SAME)))
    clean = lambda c: F.substring(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(EDGES)), 1, VALUE_CHARS)

    def value(name: str, pattern: str) -> Column:
        found = clean(F.regexp_extract("_window", f"(?idmU){pattern}", 1))
        if name in WORDS and not everywhere:
            return F.when(reduce(lambda a, b: a | b, (F.contains("_plain", F.lit(w)) for w in WORDS[name])), found)
        return F.when(F.col("_window").rlike(NEEDS[name]), found) if name in NEEDS and not everywhere else found

    found = [F.struct(F.lit(name).alias("type"), value(name, p).alias("value")) for name, p in PATTERNS.items()]
    return read.select(key, F.inline(F.array(*found))).filter("value <> ''")
