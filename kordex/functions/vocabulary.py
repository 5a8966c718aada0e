"""Fixed values of the catalogue domain: headers, aliases, stop words, weights, vocabularies.

They are data: every operator takes them as parameters and these are the defaults.
"""

from __future__ import annotations

# Canonical columns and the headers that stand for them.
NAME, PRICE, ARTICLE = "Наименование", "Цена розничная", "Артикул"
REQUIRED = (NAME, PRICE, ARTICLE)
HEADER_ALIASES = {
    NAME: ("наименование", "наименование товара", "наименование продукции", "номенклатура", "товар", "product name", "name"),
    PRICE: ("цена розничная", "розничная цена", "розница", "цена продажи", "цена", "retail price", "price"),
    ARTICLE: ("артикул", "артикул товара", "код товара", "код номенклатуры", "код", "sku", "vendor code", "партномер", "part number", "partnumber"),
}
CATEGORY_COLUMNS = ("Название класса", "Тип изделия", "Производитель")
DEFAULT_FILLS = {"Единица измерения": "шт", "НДС": "20", "Страна происхождения": "РФ"}
ZERO_WORDS = ("цена", "количество", "вес", "объем")

# Words that carry no meaning, and spellings that mean one term, in order of replacement.
STOP_WORDS = ("и", "в", "во", "на", "для", "с", "со", "по", "из", "шт", "мм", "см", "м", "к", "за", "u", "the", "zero")
TERM_ALIASES = {
    "patch cord": "патч корд",
    "patch-cord": "патч корд",
    "patchcord": "патч корд",
    "патч-корд": "патч корд",
    "патчкорд": "патч корд",
    "шнур коммутационный": "патч корд",
    "коммутационный шнур": "патч корд",
    "zero-u": "zero u",
    '19"': "19 inch",
    "19''": "19 inch",
}
SYNONYMS = {
    "коммутационный шнур": "патч корд",
    "патч-корд": "патч корд",
    "патчкорд": "патч корд",
    "zero-u": "zero u",
    '19"': "19 inch",
    "19''": "19 inch",
    "cat 6": "cat6",
    "кат 6": "cat6",
    "cat 5e": "cat5e",
    "кат 5e": "cat5e",
}
# Endings of words, of which one is cut, the first that fits in this order; the separator of branches and the branch of the rest.
ENDINGS = ("иями", "ями", "ами", "ого", "ему", "ому", "ыми", "ими", "иях", "ией", "ией", "ий", "ый", "ой", "ая", "ое", "ые", "ие", "ов", "ев", "ам", "ям", "ах", "ях", "ы", "и", "а", "я", "о", "е", "у", "ю")
BRANCH_SEPARATOR = " > "
FALLBACK_BRANCH = "прочее"

# Rules that send a term to a branch, with weights.
KEYWORD_ROUTES = (
    (("pdu", "блок розеток"), ("телеком", "питание", "pdu"), 4.0),
    (("zero u",), ("телеком", "питание", "pdu", "zero u"), 5.0),
    (("патч панель", "патч-панель"), ("телеком", "коммутация", "патч панели"), 4.5),
    (("патч корд", "patch cord"), ("телеком", "кабели", "патч корды"), 4.5),
    (("органайзер",), ("телеком", "аксессуары", "кабельные органайзеры"), 4.0),
    (("шкаф", "стойк"), ("телеком", "шкафы"), 3.2),
    (("датчик",), ("автоматика", "датчики"), 3.2),
    (("кабель", "utp", "ftp"), ("электрика", "кабели"), 2.8),
    (("провод",), ("электрика", "провода"), 2.8),
    (("автомат",), ("электрика", "автоматы"), 3.5),
    (("розетка",), ("электрика", "розетки"), 3.0),
    (("светильник",), ("свет", "светильники"), 3.0),
)
# What a request asks for and the texts that then count against an item; patterns of attributes; words of section rows.
CONFLICT_RULES = (("zero_u", ("1u",), 0.18), ("rack_1u", ("zero u",), 0.18), ("category_cat6", ("cat5e",), 0.2), ("category_cat5e", ("cat6",), 0.2))
ATTRIBUTE_PATTERNS = (
    ("category", r"\bcat\s*6a?\b|\bкат\s*6a?\b", "cat6"),
    ("category", r"\bcat\s*5e\b|\bкат\s*5e\b", "cat5e"),
    ("rack_unit", r"\bzero\s*u\b", "zero u"),
    ("rack_unit", r"\b(\d+)\s*u\b", 1),
    ("rack_size", r"\b19\s*(?:inch|дюйм)\b", "19 inch"),
)
SECTION_WORDS = ("шкафы", "кабели", "коммутация", "электрика", "датчики", "свет", "аксессуары", "оборудование")

# Weights of the local score, of mismatching markers, and thresholds.
JACCARD_WEIGHT, RATIO_WEIGHT = 0.75, 0.25
EQUAL_BONUS = (("connector_pair", 0.18), ("sensor_kind", 0.18), ("mount_kind", 0.15), ("installation_kind", 0.15), ("fiber_mode", 0.15), ("category", 0.12))
MISMATCH = (
    ("connector_pair", 0.28), ("sensor_kind", 0.28), ("mount_kind", 0.22), ("accessory_kind", 0.26), ("orientation_kind", 0.18), ("position_kind", 0.18), ("installation_kind", 0.22),
    ("shielding", 0.24), ("cable_environment", 0.24), ("fiber_mode", 0.22), ("duplex", 0.12), ("category", 0.18), ("designation_family", 0.3), ("length_m", 0.08), ("rack_unit", 0.12),
)
HARD_PENALTY, WEAK_FROM, CONFIDENT, MARGIN, BRANCH_GAP = 0.6, 0.2, 0.92, 0.08, 0.15

# Sources of a result that need no review.
AUTO_ACCEPT_SOURCES = ("article_exact", "article_extracted_exact", "article_designation_exact", "name_exact", "normalized_name_exact")

# Parts of an incompatibility code and the gap reason they mean, first hit wins.
GAP_REASONS = (
    ("category", "category_mismatch"), ("shield", "shielding_mismatch"), ("connector", "connector_mismatch"), ("component", "component_kind_mismatch"), ("installation", "installation_kind_mismatch"),
    ("floor_box_vs_power_item", "installation_kind_mismatch"), ("port_count", "port_count_mismatch"), ("fiber", "fiber_mode_mismatch"), ("optical_marker", "fiber_mode_mismatch"),
    ("environment", "environment_mismatch"), ("rack", "rack_form_factor_mismatch"), ("form_factor", "rack_form_factor_mismatch"), ("airflow", "rack_form_factor_mismatch"),
)
