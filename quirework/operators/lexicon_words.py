"""Words by which the lexicon engine tells remarks, quotations and leftovers from headwords.

They are put together from parts (a conjunction, a verb of saying, what is said), so that spellings with and
without the conjunction or the article go together.
"""

from __future__ import annotations

from collections.abc import Iterable

AND = ("", "و")
SO = ("", "و", "ف")
SAID = "قال قيل يقال قرأ أنشد".split()
SOURCES = "حديث رواية قراءة قول كلام خبر أثر".split()
VOWELS = "ضم فتح كسر".split()
SCHOLARS = "الخليل سيبويه الليث الكسائي الفراء الأصمعي ثعلب المبرد الزجاج الأزهري الجوهري الزمخشري الصاغاني الفيروزآبادي الزبيدي".split()
CHAPTER_WORDS = "باب فصل كتاب حرف".split()


def each(*parts: Iterable[str], sep: str = "") -> list[str]:
    """Every way to choose one of each part, joined."""
    out = [""]
    for k, part in enumerate(parts):
        out = [a + (sep if k else "") + b for a in out for b in part]
    return out


VOWELLED = [*each(["ب"], VOWELS), *each(["بال"], VOWELS), "بالتحريك", "بالسكون"]
NAMED_SOURCES = [*SOURCES, *each(["ال"], ["حديث", "خبر", "أثر"])]
#: How a quotation or a remark begins.
OPENERS = [*each(SO, SAID), "قلت", "قال الشاعر", "حديث", "قراءة", *each(AND, ["في "], NAMED_SOURCES), *each(["ومنه", "ومنها"], ["قول", "حديث"], sep=" ")]
#: What comes before a quotation.
TAILS = [
    *VOWELLED, *NAMED_SOURCES[:1], "الحديث", "جل وعز", "عز وجل", "كرم الله", "صلى الله عليه", *each(["رضي الله عن"], ["ه", "ها", "هما", "هم"]),
    *each(AND, ["في ", "من "], ["التنزيل", "التنزيل العزيز", "المجاز"]), *each(AND, ["في "], [*SOURCES, "صفة", "خطبته", "مقتل"]), *each(["ومنه", "ومنها"], [*SOURCES, "الحديث"], sep=" "),
    *each(AND, ["قال "], ["ابن", "ابو"]), *each(["عن "], ["ابن", "ابي"]), *each(["قوله جل"], ["", " وعز"]),
]
#: After a comma: a gloss of the headword and not another one.
QUALIFIERS = ["أي", "قال", "يريد", *each(AND, ["يقال", "يقول"]), "تقول", *each(["والجم"], ["ع", "يع"]), *each(["وجمع"], ["ه", "ها"])]
#: Titles and notes of the edition that are no headwords.
LEAKS = [*each(["آخر "], CHAPTER_WORDS), "كتاب حرف", *each(["", "ل", "ال"], ["جزء"]), "ومما يستدرك"]
LEAK_WORDS = [*CHAPTER_WORDS, "أبواب", *each(["الم"], ["عجمة", "هملة", "ثناة", "ثلثة"])]
#: A page that ends with one of these goes on on the next.
GOING_ON = [*VOWELLED, *"إذا ثم على إلى في من عن أن نحو مثل قالوا قلت وجل".split(), *each(SO, ["قال"]), *each(AND, ["قيل", "يقال"])]
MARKER_STARTS = ["بسم الله", "الحمد لله", "توكلت على الله", *each(["آخر ", "تم "], ["كتاب"]), "ويتلوه"]
NOISE = ["قال", "يعني", "فإذا", *each(["و"], ["في", "قيل", "يقال"])]
