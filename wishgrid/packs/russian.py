"""Fixed values of the Russian wish pack: patterns and word lists, in their order of use.

The patterns decide what is recognised and must stay as they are for equal results. They are
written as Java regular expressions over normalised text.
"""

from wishgrid.functions.spans import Rule

# Building blocks.
NUM = r"\d{1,3}(?:[ \xa0 ]\d{3})+|\d+(?:[.,]\d+)?"
NOT_LINE_NUMBER = r"(?<![^\W\d_]-)"
DIST_MARKER = r"(?:не\s+дальше|не\s+бол(?:ее|ьше)|не\s+далее|в\s+пределах|максимум|до|в)"
DIST_UNIT = r"(?:км\b|километр\w*|минут\w*|м\b|метр\w*)"
DIST_NUM = r"\d+(?:[.,]\d+)?(?:\s*[-–—]\s*\d+(?:[.,]\d+)?)?"
PROXIMITY = (
    r"(?:рядом(?:\s+с|\s+со)?|поближе(?:\s+к|\s+ко)?|ближе(?:\s+к|\s+ко)?|ближайш\w+(?:\s+к|\s+ко)?"
    r"|недалеко(?:\s+от)?|неподалеку(?:\s+от)?|неподалёку(?:\s+от)?|поблизости(?:\s+от)?|вблизи"
    r"|близко(?:\s+к|\s+ко)?|около|возле|у\b|к\b)"
)

# Rooms.
CARDINAL = r"(?:одн[аоу]|дв(?:е|ух)|тр(?:и|ех)|четыр(?:е|ех)|пят[иь])"
ROOM_RULES = [
    Rule(
        "negated",
        r"\b(?:не|кроме|без|точно\s+не)\s+(?:студи\w*|однушк\w*|однокомнатн\w*|двушк\w*|двухкомнатн\w*"
        r"|трешк\w*|трех[ауи]\b|трехкомнатн\w*|четырехкомнатн\w*|многокомнатн\w*"
        rf"|{CARDINAL}\s+комнат\w*|\d\s*[-–—]?\s*(?:комнат\w*|комн\.|к\b))",
    ),
    Rule("studio", r"\bстуди\w*"),
    Rule("one", r"\bоднушк\w*|\bоднокомнатн\w*"),
    Rule("two", r"\bдвушк\w*|\bдвухкомнатн\w*"),
    Rule(
        "three_plus",
        r"\bтрешк\w*|\bтрех[ауи]\b|\bтрехкомнатн\w*|\bчетырехкомнатн\w*|\bмногокомнатн\w*",
    ),
    Rule("from_word", r"\bот\s+(одн\w+|двух|трех|четырех|пяти)\s+комнат\w*", 1),
    Rule(
        "cardinal",
        rf"\b({CARDINAL}(?:\s*[-–—,/]\s*{CARDINAL}|\s+(?:и(?:ли)?|либо)\s+{CARDINAL})*)\s+(?:комнат\w*|комн\.)",
        1,
    ),
    Rule(
        "digits",
        rf"(?:\bдаже\s+)?\b{NOT_LINE_NUMBER}(\d(?:\s*[-–—,/]\s*\d|\s+(?:и(?:ли)?|либо)\s+\d)*)(?:\s*\+)?"
        r"(?:\s*[-–—]?\s*х)?\s*[-–—]?\s*(?:комнат\w*|комн\.|к\b)(?:\s+кв-р\w*|\s+квартир\w*|\s+кв\b)?",
        1,
    ),
    Rule("plus", rf"\b{NOT_LINE_NUMBER}(\d)\s*\+(?!\s*\d)", 1),
]

# Price.
PRICE_UNIT = r"млн\.?|миллион\w*|лям\w*|тыс\w*|руб\w*|р\.|₽"
OPT_RUB = r"(?:\s+(?:рублей|руб\w*|р\.|₽))?"
RUBLE_THRESHOLD = 100000
PRICE_RULES = [
    Rule(
        "range",
        rf"\b(?:(?:бюджет\w*|цена|стоимость\w*)\s*[—:\-]?\s*)?(?:от\s+)?{NOT_LINE_NUMBER}({NUM})\s*"
        rf"({PRICE_UNIT}|[мmкk])?\s*(?:[-–—]|до)\s*{NOT_LINE_NUMBER}({NUM})\s*({PRICE_UNIT}|[мmкk])?{OPT_RUB}(?![\w²])",
        4,
    ),
    Rule(
        "budget",
        rf"\b(?:бюджет\w*|цена|стоимость\w*|баб\w+)\s*[—:\-]?\s*(не\s+более|до|от)?\s*({NUM})\s*"
        rf"({PRICE_UNIT}|м|m|к|k)?{OPT_RUB}(?![\w²])",
        3,
    ),
    Rule("min", rf"\b(?:не\s+менее|от|не\s+дешевле|минимум)\s+({NUM})\s*({PRICE_UNIT}){OPT_RUB}(?![\w²])", 2),
    Rule(
        "max",
        rf"\b(?:не\s+более|до|не\s+дороже|не\s+больше|максимум|в\s+пределах)\s+({NUM})\s*({PRICE_UNIT}){OPT_RUB}(?![\w²])",
        2,
    ),
    Rule("for", rf"\bза\s+({NUM})\s*({PRICE_UNIT}){OPT_RUB}(?![\w²])", 2),
    Rule("unit_first", rf"\b({PRICE_UNIT})\s+за\s+({NUM}){OPT_RUB}(?![\w²])", 2),
    Rule("suffix", rf"\b(до|от|за)\s+({NUM})([мmкk]){OPT_RUB}\b", 3),
    Rule("plain_min", rf"\b(?:от|не\s+дешевле)\s+({NUM}){OPT_RUB}\b", 1),
    Rule("plain_max", rf"\b(?:до|не\s+дороже)\s+({NUM}){OPT_RUB}\b", 1),
    Rule("standalone", rf"\b({NUM})\s*({PRICE_UNIT}){OPT_RUB}\b", 2),
]

# Area.
AREA_UNIT = r"(?:м²|м2|кв\.?\s*метр\w*|кв\.?\s*м\.?|квадрат\w*|метр\w*)"
AREA_FILLER = r"(?:(?:была|будет|есть|чтоб\w*|больш\w*|маленьк\w*)\s+)*"
KITCHEN_COMPOUND = r"(?:\s*[-–—]\s*|\s+)(?:гостин\w*|столов\w*|ниш\w*)"
AREA_RULES = [
    Rule(
        "kitchen",
        rf"(?:с\s+)?\b(?:кухн\w*|кузн\w*)(?:{KITCHEN_COMPOUND})?\s*{AREA_FILLER}[—:\-]?\s*"
        rf"(?:(?:(?:от|ат)\s+)?({NUM})\s*(?:[-–—]|до)\s*({NUM})|(?:от|ат|не\s+меньше|минимум)\s+({NUM})"
        rf"|(?:до|не\s+больше|максимум)\s+({NUM})|({NUM}))(?:\s*{AREA_UNIT})?",
        5,
    ),
    Rule(
        "keyword",
        rf"(?:(?:общ\w+\s+)?\bплощад\w*(?:\s+общ\w+)?|\bобщ\w+|\bквадрат\w*)\s*{AREA_FILLER}[—:\-]?\s*"
        rf"(?:(?:от\s+)?({NUM})\s*(?:[-–—]|до)\s*({NUM})|(?:от|не\s+меньше|минимум)\s+({NUM})"
        rf"|(?:до|не\s+больше|максимум)\s+({NUM})|({NUM}))(?:\s*{AREA_UNIT})?",
        5,
    ),
    Rule(
        "range",
        rf"\b(?:от\s+)?{NOT_LINE_NUMBER}({NUM})\s*(?:[-–—]|до)\s*{NOT_LINE_NUMBER}({NUM})\s*{AREA_UNIT}",
        2,
    ),
    Rule("min", rf"\b(?:от|не\s+меньше|минимум)\s+({NUM})\s*{AREA_UNIT}", 1),
    Rule("max", rf"\b(?:до|не\s+больше|максимум)\s+({NUM})\s*{AREA_UNIT}", 1),
    Rule("squares", rf"\b({NUM})\s*квадрат\w*|\bквадрат\w*\s+({NUM})\b", 2),
]

# Floors.
STOREYS = r"(?:\bэтажност\w*\s+)?"
FLOOR_LIMIT = 200
FLOOR_RULES = [
    Rule("range", rf"{STOREYS}\b(?:с|от)\s+(\d+)\s+(?:по|до)\s+(\d+)\s*(?:-?го)?\s*этаж\w*", 2),
    Rule("range", r"\bэтаж\w*\s*[—:\-]?\s*(?:с|от)\s+(\d+)\s+(?:по|до)\s+(\d+)", 2),
    Rule("range", r"\b(\d+)\s*[-–—]\s*(\d+)\s+этаж\w*", 2),
    Rule("range", r"\bэтаж\w*\s*[—:\-]?\s*(\d+)\s*[-–—]\s*(\d+)", 2),
    Rule("range", r"\b(?:с|от)\s+(\d+)\s+(?:по|до)\s+(\d+)\b", 2),
    Rule("max", rf"{STOREYS}\b(?:не\s+выше|до)\s+(\d+)(?:-?го)?\s+этаж\w*", 1),
    Rule("min", rf"{STOREYS}\b(?:не\s+ниже|от|начиная\s+с|с|выше)\s+(\d+)(?:-?го)?\s+этаж\w*", 1),
    Rule("max", r"\bэтаж\w*\s*[—:\-]?\s*(?:не\s+выше|до)\s+(\d+)(?:-?го)?\b", 1),
    Rule("min", r"\bэтаж\w*\s*[—:\-]?\s*(?:не\s+ниже|от|начиная\s+с|с|выше)\s+(\d+)(?:-?го)?\b", 1),
    Rule("not_first", r"\b(?:не\s+(?:на\s+)?|кроме\s+|выше\s+)перв\w+(?:\s+этаж\w*)?"),
    Rule(
        "not_first",
        r"\bперв\w+\s+этаж\w*\s+(?:не\s+(?:предлаг\w+|надо|нужн\w+|интересу\w+|хоч\w+|рассматрив\w+|показыв\w+)|исключ\w+)",
    ),
    Rule(
        "not_first",
        r"\bвысок\w+\s+этаж\w*|\bэтаж\w*\s+высок\w+|\bэтаж\w*\s+повыше|\bповыше\s+этаж\w*",
    ),
    Rule("not_last", r"\b(?:не|без|только\s+не|кроме)\s+(?:на\s+)?последн\w+(?:\s+этаж\w*)?"),
    Rule("last", r"\b(?:на\s+)?последн\w+(?:\s+этаж\w*)?"),
    Rule("first", r"\bперв\w+\s+этаж\w*"),
]

# Finish (0 none, 1 ready, 2 white box, 3 furnished).
WHITE_BOX = r"(?:w[hн][iі][tт][eе][\s-]?[bв][oо][xх]|вайт[\s-]?бокс)\w*"
FINISH_RULES = [
    Rule("0", r"\bбез\s+(?:отделки|ремонта)\b|\bчернов\w+(?:\s+отделк\w+)?|\bотделк\w*\s+чернов\w+"),
    Rule(
        "2",
        rf"\bпредчистов\w+(?:\s+отделк\w+)?|\bотделк\w*\s+предчистов\w+|\b(?:с\s+)?отделк\w*\s+{WHITE_BOX}|\b{WHITE_BOX}(?:\s+отделк\w+)?",
    ),
    Rule("3", r"\b(?:готов\w+\s+)?отделк\w+\s+с\s+мебелью\b|\bс\s+мебель\w+"),
    Rule(
        "1",
        r"\bс\s+отделк\w+|\bс\s+ремонт\w+|\bчистов\w+(?:\s+отделк\w+)?|\bотделк\w*\s+чистов\w+|\bготов\w+\s+отделк\w+"
        r"|\bотделк\w*\s+(?:уже\s+)?готов\w+|\b(?:с\s+)?отделк\w*\s+под\s+ключ\b|\bпод\s+ключ\b",
    ),
]
READY = Rule(
    "ready",
    r"\bзаселение\s+сразу\b|\bготов\w+\s+дом\w*|\bдом\w*\s+(?:уже\s+)?готов\w*|\bсдан\w*|\bможно\s+(?:сразу\s+)?заехать\b|\bключи\s+сразу\b",
)

# Year of settlement, first matching form wins.
SETTLE = r"\b(?:заселение|сдача|въезд)\s+"
SETTLEMENT_RULES = [
    Rule(
        "range",
        SETTLE + r"(?:с\s+|в\s+)?(\d{4})(?:\s+год\w*)?\s*(?:по|до|[-–—])\s*(\d{4})(?:\s+год\w*)?\b",
        2,
    ),
    Rule("max", SETTLE + r"(?:до|по|не\s+позднее)\s+(\d{4})(?:\s+год\w*)?\b", 1),
    Rule("min", SETTLE + r"(?:с|от|после|не\s+раннее|не\s+ранее)\s+(\d{4})(?:\s+год\w*)?\b", 1),
    Rule("exact", SETTLE + r"(?:в\s+)?(\d{4})(?:\s+год\w*)?\b", 1),
    Rule("this_year", SETTLE + r"в\s+этом\s+году\b"),
]

# Sort order, first pattern that occurs wins.
SORT_RULES = [
    Rule(
        "price_asc",
        r"\bп[оа]дешевле\b|\bсначала\s+(?:по)?дешев\w+|\bдешевле\s+сначала\b|\bсначала\s+недорог\w+"
        r"|\bпо\s+возрастанию\s+цены\b|\bот\s+дешев\w+\s+к\s+дорог\w+",
    ),
    Rule(
        "price_desc",
        r"\bп[оа]дороже\b|\bсначала\s+(?:по)?дорог\w+|\bдороже\s+сначала\b|\bпо\s+убыванию\s+цены\b",
    ),
    Rule(
        "area_desc",
        r"\bплощад\w*\s+побольше\b|\bпобольше\s+площад\w*|\bпо\s+убыванию\s+площади\b"
        r"|\bсначала\s+(?:самые\s+)?просторн\w+|\bсначала\s+(?:самые\s+)?больш\w+",
    ),
    Rule(
        "area_asc",
        r"\bплощад\w*\s+поменьше\b|\bпоменьше\s+площад\w*|\bпо\s+возрастанию\s+площади\b"
        r"|\bсначала\s+(?:самые\s+)?маленьк\w+|\bсначала\s+небольш\w+",
    ),
]

# Required tags.
TAG_RULES = [
    Rule("zos", r"\bготов\w+\s+квартир\w+"),
    Rule("cashback", r"\bипотек\w+\s+по\s+формуле\s+\d[.,]?\d*%?"),
    Rule(
        "crossed",
        r"\b(?:специальн\w+\s+цен\w*|спецпредложени\w*)(?:\s+до\s+\d{1,2}\.\d{2}(?:\.\d{2,4})?)?",
    ),
    Rule("outlet", r"\bвыгода\s+до\s+-?\d{1,2}%(?:\s+до\s+\d{1,2}\.\d{2}(?:\.\d{2,4})?)?"),
]

# Flags.
FLATS_ONLY = Rule("flats_only", r"\bтолько\s+квартир\w*|\bбез\s+апартаментов\b|\bне\s+апартамент\w*")
ONLY_AVAILABLE = Rule(
    "only_available",
    r"\bне\s+бронь\b|\bбез\s+брони\b|\bне\s+забронированн\w+|\bтолько\s+свободн\w+|\bтолько\s+доступн\w+|\bне\s+показывать\s+забронирован\w+",
)

# What the search cannot filter, with a reason code.
UNSUPPORTED_RULES = [
    Rule("resale", r"\bвторичк\w*|\bвторичн\w+(?:\s+(?:рынок|рынке|рынка|жиль\w*|фонд\w*))?"),
    Rule(
        "side_of_world",
        r"\b(?:солнечн\w+|светл\w+|темн\w+|южн\w+|северн\w+|восточн\w+|западн\w+)\s+сторон\w*|\bсторон\w+\s+света\b",
    ),
    Rule("separate_bathroom", r"\bраздельн\w+\s+(?:санузел|санузл[ауе]|санузлом)\b"),
    Rule("house_material", r"\b(?:кирпичн\w+|монолитн\w+|панельн\w+|блочн\w+)\s+дом\w*"),
]

# Side of the ring road.
INSIDE_RING = Rule("inside", r"\b(?:внутри|в\s+пределах|в\s+черте)\s+мкад\w*(?:\s+кольц\w*)?\b")
BEYOND_RING = Rule("beyond", r"\b(?:за\s+пределами|за\s+пределы|вне|за)\s+мкад\w*(?:\s+кольц\w*)?\b")
NAMED_STATION = Rule("station", r"(?i)\bу\s+метро\s+([а-яА-ЯёЁ-]+)", 1)

# Time to transit.
PREP = r"(?:в|до|от|за|не\s+более|менее|на)"
MINUTES = r"(?:минут\w*|мин\w*)"
METRO = r"(?:метро|станци\w*)"
TRANSPORT = r"(?:транспорт\w*|машин\w*|авто|автомобил\w*)"
FOOT = r"(?:пешком|пешк\w*|шаг\w*|ходьб\w*)"
MINUTE_WORDS = {
    "одна": 1, "одну": 1, "один": 1, "две": 2, "два": 2, "двух": 2, "три": 3, "трех": 3,
    "четыре": 4, "четырех": 4, "пять": 5, "пяти": 5, "шесть": 6, "шести": 6, "семь": 7, "семи": 7,
    "восемь": 8, "восьми": 8, "девять": 9, "девяти": 9, "десять": 10, "десяти": 10,
    "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15,
    "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19, "двадцать": 20,
    "тридцать": 30,
}
MINUTE_NUM = r"(?:\d+|" + "|".join(sorted(MINUTE_WORDS, key=len, reverse=True)) + ")"
WALK_VERB = r"(?:идти|ити|дойти|идёт|идет|ходить|добираться)"
FILLER = r"(?:было|нужно|надо|желательно|хотелось\s+бы)"
ACCESS = r"(?:пеш\w+\s+|шагов\w+\s+)?доступност\w+"
TRANSIT_RULES = [
    Rule("transport", rf"\b(?:{PREP}\s+)?{METRO}\s+(?:{PREP}\s+)?{TRANSPORT}(?:\s+{PREP})?\s+({MINUTE_NUM})(?:\s+{MINUTES})?\b", 1),
    Rule("transport", rf"\b(?:{PREP}\s+)?{METRO}\s+(?:{PREP}\s+)?{TRANSPORT}(?:\s+{PREP})?\s+{MINUTES}\s+({MINUTE_NUM})\b", 1),
    Rule("transport", rf"\b(?:{PREP}\s+)?({MINUTE_NUM})(?:\s+{MINUTES})?(?:\s+{PREP})?(?:\s+{METRO})?(?:\s+{PREP})?\s+{TRANSPORT}\b", 1),
    Rule("transport", rf"\b(?:{PREP}\s+)?{METRO}(?:\s+{PREP})?\s+({MINUTE_NUM})(?:\s+{MINUTES})?(?:\s+{PREP})?\s+{TRANSPORT}\b", 1),
    Rule("foot", rf"\b{METRO}(?:\s+\w+){{0,3}}?\s+{ACCESS}\s+(?:{PREP}\s+)?({MINUTE_NUM})\s*{MINUTES}", 1),
    Rule("foot_free", rf"\b{ACCESS}\s+(?:{PREP}\s+)?({MINUTE_NUM})\s*{MINUTES}", 1),
    Rule("foot", rf"\b(?:{PREP}\s+)?{METRO}\s+(?:(?:{PREP}|{FILLER})\s+){{0,2}}(?:{FOOT}|{WALK_VERB})(?:\s+{PREP})?\s+({MINUTE_NUM})(?:\s+{MINUTES})?\b", 1),
    Rule("foot", rf"\b(?:{PREP}\s+)?{METRO}\s+(?:(?:{PREP}|{FILLER})\s+){{0,2}}(?:{FOOT}|{WALK_VERB})(?:\s+{PREP})?\s+{MINUTES}\s+({MINUTE_NUM})\b", 1),
    Rule("foot", rf"\b(?:{PREP}\s+)?({MINUTE_NUM})(?:\s+{MINUTES})?(?:\s+{PREP})?\s+{METRO}\b", 1),
    Rule("foot", rf"\b(?:{PREP}\s+)?{METRO}(?:\s+{PREP})?\s+({MINUTE_NUM})(?:\s+{MINUTES})?(?:\s+{FOOT})?\b", 1),
    Rule("foot_free", rf"\b(?:{PREP}\s+)?({MINUTE_NUM})(?:\s+{MINUTES})?\s+{FOOT}\b", 1),
]
CUE_WINDOW = 70
POI_CUE = (
    r"магазин|продукт|супермаркет|поликлиник|больниц|аптек|роддом|медцентр|клиник|госпитал|школ|садик|детсад"
    r"|детск\w+\s+сад|сад(?:ы|ов|ам|ами|ах)\b|парковк|паркинг|парк(?:а|у|е|ом|и|ов|ам|ах)?\b|лес(?:а|у|ом)?\b"
)
METRO_CUE = "метро|станц"

# Places of interest. Groups: 1 new, 2 distance, 3 unit.
WALK_WORD = r"(?:пешком|пешк\w+|ходьб\w+|идти|хода)"
POI_PREFIX = r"(?:(?:с|со)\s+)?(\bнов\w+\s+)?"
POI_SUFFIX = (
    r"(?:\s+(?:поблизости(?!\s+от\b)|неподалеку(?!\s+от\b)|неподалёку(?!\s+от\b)|недалеко(?!\s+от\b)"
    r"|рядом(?:\s+с\s+ним\b)?(?!\s+со?\b)|близко(?!\s+ко?\b)|вблизи(?!\s+[а-яё])))?"
    rf"(?:\s+(?:{WALK_WORD}\s+)?(?:{DIST_MARKER}\s*)?({DIST_NUM})\s*({DIST_UNIT})(?:\s+{WALK_WORD})?)?"
)
NOT_A_VIEW = "(?<!вид на )(?<!видом на )"
NOT_A_STATION = r"(?<!метро )(?<!м\. )(?<!м\.)(?<!станция )(?<!станции )(?<!ст\. )"


def _poi(category: str, core: str, before: str = POI_PREFIX) -> Rule:
    return Rule(category, before + core + POI_SUFFIX, 3)


CENTRE = Rule(
    "centre",
    r"\b(?:в\s+центре|к\s+центру|близко\s+к\s+центру|ближе\s+к\s+центру|вблизи\s+центра|около\s+центра)(?:\s+москв\w*)?\b",
)
POI_RULES = [
    _poi("school", NOT_A_VIEW + r"\bшкол(?!ьник)(?:\w+|\b)"),
    _poi("kindergarten", r"(?:\bсадик\w*|\bдетск\w+\s+сад\w*|\bдетсад\w*)"),
    _poi("kindergarten", r"\bсад(?:ы|ов|ам|ами|ах)\b"),
    _poi("kindergarten", r"\bсад(?:а|у|ом|е)?\b", r"(?:(?:с|со)\s+)?(\bнов\w+\s+)"),
    _poi("kindergarten", r"\bсад(?:а|у|ом|е)\b", r"\b(?:до|ко|к|у|возле|около|близ)\s+(\bнов\w+\s+)?"),
    _poi("shop", r"(?:\bмагазин\w*|\bпродукт\w+|\bсупермаркет\w*)"),
    _poi("parking", r"(?:\bпарковк\w*|\bпаркинг\w*)"),
    _poi("park_forest", NOT_A_VIEW + r"\b(?:лес\w*|парк\w*|зелен\w+)"),
    _poi("dentist", r"(?:\bстоматолог\w*|\bзубн\w+\s+врач\w*|\bзубн\w+)"),
    _poi(
        "medical",
        r"(?:\bполиклиник\w*|\bбольниц\w*|\bаптек\w*|\bроддом\w*|\bмедцентр\w*|\bмед\.?\s*центр\w*|\bклиник\w*|\bгоспитал\w*)",
    ),
    _poi("university", NOT_A_STATION + r"(?:\bуниверситет\w*|\bвуз\w*|\bинститут\w*)"),
    _poi(
        "sport",
        r"(?:\bфитнес\w*|\bспортзал\w*|\bтренажерн\w+|\bтренажёрн\w+|\bбассейн\w*|\bспортивн\w+\s+центр\w*|\bспорткомплекс\w*)",
    ),
    _poi(
        "food",
        r"(?:\bкафе\b|\bресторан\w*|\bстолов\w+|\bпиццери\w+|\bфастфуд\w*|\bфуд[\s-]?корт\w*|\bбургер[\s-]?кинг\w*"
        r"|\bмакдо\w*|\bкфс\b|\bkfc\b|\bвкусно\s+и\s+точка\b)",
    ),
    _poi(
        "mall",
        r"(?:\bторгов\w+\s+центр\w*|\bторгов\w+\s+комплекс\w*|\bтрц\b|\bтц\b|\bмолл\w*|\bунивермаг\w*)",
    ),
    _poi("cinema", r"(?:\bкинотеатр\w*|\bкино\b)"),
    _poi("bank", r"(?:\bбанк(?:а|у|ом|е|и|ов|ам|ами|ах)?\b|\bбанкомат\w*)"),
    _poi("post", r"(?:\bпочт\w*|\bпочтов\w+\s+отделен\w+)"),
]
LEADING_DISTANCE = (
    rf"(?:\b{PROXIMITY}\s+[^\d,;.!?()]{{0,25}}?)?{DIST_MARKER}\s*({DIST_NUM})\s*({DIST_UNIT})[^\d,;.!?()]{{0,20}}$"
)
TRAILING_DISTANCE = (
    rf"^\s[^\d,;.!?()]{{0,22}}?{DIST_MARKER}\s*({DIST_NUM})\s*({DIST_UNIT})(?:\s+{WALK_WORD})?"
)
ENUMERATION = r"^[\s,]*(?:и|или|либо|а\s+также)?[\s,]*$"

# Landmarks.
NEAR_MARKER = (
    r"\b(?:рядом\s+со|рядом\s+с|поближе\s+ко|поближе\s+к|ближе\s+ко|ближе\s+к|ближайш\w+\s+ко|ближайш\w+\s+к"
    r"|недалеко\s+от|неподалеку\s+от|неподалёку\s+от|вблизи|близко\s+ко|близко\s+к|около|возле|у|к)\s+"
)
SUPERLATIVE_PREFIX = (
    r"(?:\b(?:сам(?:ый|ая|ую|ое|ые|ых|ым|ыми|ой|ому|ом)|наиболее|максимально)\s+(?:близк\w+\s+)?"
    r"|\bближе\s+всего\s+|\bкак\s+можно\s+)$"
)
SUPERLATIVE_CUE = (
    r"\b(?:ближайш\w+(?!\s+(?:врем|будущ))|ближе\s+всего|как\s+можно\s+ближе"
    r"|(?:наиболее|максимально|сам(?:ый|ая|ую|ое|ые|ых|ым|ыми|ой|ому|ом))\s+близк\w+)"
)
LANDMARK_DISTANCE = (
    rf"^\s+(?:не\s+дальше|не\s+более|не\s+далее|в\s+пределах|максимум|в)\s*({DIST_NUM})\s*({DIST_UNIT})"
)
LANDMARK_WORD = r"[а-яёa-z0-9]+(?:[.-][а-яёa-z0-9]+)*"
LANDMARK_SCORE = 88.0
LANDMARK_WINDOW = 3

# Classes of stations. Groups of explicit forms: line, distance, unit.
LINE_TOKEN = r"(?:мцд|мцк)(?:-\d+)?"
QUALIFIER = r"(?:\s+не\s+важно\s+как\w*(?:\s+(?:станци\w*|линии))?)?"
DISTANCE_AFTER = rf"(?:\s+(?:{DIST_MARKER}\s*)?({DIST_NUM})\s*({DIST_UNIT})|\s+в\s+пешей\s+доступности)?"
CARRIER = r"(?:ветк|лини)\w*"
LINE_BEFORE = Rule(
    "before", rf"(?:{DIST_MARKER}\s*)?({DIST_NUM})\s*({DIST_UNIT})\s+от\s+(?:станци\w*\s+|линии\s+)?({LINE_TOKEN}){QUALIFIER}", 3
)
LINE_EXPLICIT = Rule(
    "explicit", NEAR_MARKER + rf"(?:станци\w*\s+|линии\s+)?({LINE_TOKEN}){QUALIFIER}{DISTANCE_AFTER}", 3
)
ANY_STATION_RULES = [
    Rule("any", NEAR_MARKER + rf"люб\w+\s+(?:станци\w*\s+)?метро\b{DISTANCE_AFTER}", 2),
    Rule("any", NEAR_MARKER + rf"(?:станци\w*\s+)?метро(?:\s+не\s+важно\s+как\w*(?:\s+станци\w*)?){DISTANCE_AFTER}", 2),
]
COMPOUND_COLOURS = {
    r"темно[-\s]+зелен": ["Троицкая"],
    r"светло[-\s]+зелен": ["Люблинско-Дмитровская"],
}
COLOURS = {
    "красн": ["Сокольническая"],
    "зелен": ["Замоскворецкая"],
    "син": ["Арбатско-Покровская"],
    "голуб": ["Филёвская"],
    "коричнев": ["Кольцевая"],
    "оранжев": ["Калужско-Рижская"],
    "фиолетов": ["Таганско-Краснопресненская"],
    "сер": ["Серпуховско-Тимирязевская"],
    "салатов": ["Люблинско-Дмитровская"],
    "розов": ["Некрасовская"],
    "желт": ["Калининская", "Солнцевская"],
}
ORDINALS = {
    "перв": ["Сокольническая"],
    "втор": ["Замоскворецкая"],
    "треть": ["Арбатско-Покровская"],
    "четверт": ["Филёвская"],
    "пят": ["Кольцевая"],
    "шест": ["Калужско-Рижская"],
    "седьм": ["Таганско-Краснопресненская"],
    "девят": ["Серпуховско-Тимирязевская"],
    "десят": ["Люблинско-Дмитровская"],
    "восьм": ["Калининская", "Солнцевская"],
}
LINES_WITHOUT_STEM = ("мцк", "кольцевая", "большая кольцевая")
NOT_A_ROAD = r"(?!\s*(?:авто)?дорог\w*)"
NICKNAMES = [
    (r"\bбкл\b", ["Большая кольцевая"]),
    (r"\bбольш\w*\s+кольц\w+\b" + NOT_A_ROAD, ["Большая кольцевая"]),
    (r"\bцентральн\w*\s+кольц\w+\b" + NOT_A_ROAD, ["МЦК"]),
    (r"\bдиаметр\w*\b", ["МЦД"]),
    (r"\bкольц\w+\b" + NOT_A_ROAD, ["Кольцевая"]),
]
ROAD_CONTEXT = (
    r"\b(?:мкад|цкад|ттк|садов\w*|бульварн\w*|транспортн\w*|шоссе|трасс\w*|магистрал\w*|(?:авто)?дорог\w*)\b"
)
ROAD_WINDOW = 22
ANY_LINE = "метро"

# The year forms and words of residuals.
CHUNK_WORD = r"[а-яёa-z0-9]+(?:-[а-яёa-z0-9]+)*"
CHUNK_SPLIT = r"[,;]|(?<!\d)\.(?!\d)|\s+и\s+|\s+а\s+|\s+но\s+"
MAX_OPTION_WORDS = 4
PROXIMITY_WORDS = (
    "рядом поближе ближе недалеко неподалеку поблизости вблизи близко около возле у к ко с со от метро м "
    "станция станции станций ветка ветки ветке веток линия линии линий район района районе районов округ "
    "округа округе округов жк"
).split()
GREETING_WORDS = (
    "привет приветик приветствую здравствуй здрасте здравия добрый доброе доброго день утро вечер ночи "
    "спасибо благодарю заранее извините извини простите пока свидания слушай скажи помоги помогите друг "
    "дружище бот ага угу окей ок плиз да"
).split()
PARAM_STEMS = (
    "этаж комнат площад кухн стоимост бюджет миллион рубл отделк ремонт заселен новостройк студи однушк "
    "двушк трешк четырешк метро станци район округ балкон лоджи санузел санузл парковк потолк потолок "
    "рассрочк ипотек террас кладов"
).split()
PARAM_WORDS = "цена цены цене цену ценой жк дом дома окна окно вид".split()
UNIT_WORDS = (
    "м м2 кв км километр километра километров километрах метр метра метров метрах мин минут минута минуты "
    "млн млрд тыс тысяч руб рублей лям лямов год года году годах лет этаж этажа этаже этажей комнат комнаты "
    "комната"
).split()
STOP_WORDS = (
    "в на у с по и или для к от до за около рядом хочу ищу квартиру квартиры квартира куплю мне нужна "
    "пожалуйста подскажите а но же только район районе района районам округ округе округа округам жк метров "
    "кв м метро этаж сортировка сортировки остальные варианты недвижимости покупку рассматриваю обязательно "
    "была чтобы желательно цена пик семьи семья большой может лучше ну хотя если будет то готов рассмотреть "
    "главное поближе смысле где-нибудь был было были быть отсортируй сортировать хата хату хаты купить шоб не "
    "интересует новострой ищем нет кароче короче здравствуйте мы молодая первое первом первый первого первым "
    "хорошей хороший хорошим хорошую хорошее спортивным спортивный спортивного спортивном спортивные "
    "спортивных внуков внукам внуками себе жилье жильё жилья нас просторная хорошая мцд мцк бабок бабки кв-ра "
    "бюджет готовы потратить очень важно так как любим готовить рассматриваем сразу заехать жить чтоб большая "
    "вариант любить рассматривать которая который которые которую находится находиться находятся расположен "
    "расположена располагается расположено максимально самом вблизи близко ближе совсем должны должен должна "
    "должно этих эти эта это этот эту этим этими этом"
).split()
LOCATION_MARKERS = "район районе района районам округ округе округа округам жк м метро".split()
GREETINGS = [
    "привет", "приветик", "приветики", "привет всем", "всем привет", "приветствую", "приветствую вас",
    "здравствуй", "здравствуйте", "здрасте", "здрасьте", "доброе утро", "доброго утра", "утро доброе",
    "добрый день", "доброго дня", "день добрый", "добрый вечер", "доброго вечера", "вечер добрый",
    "доброй ночи", "доброго времени суток", "доброго времени", "хай",
]

# Types triggered by the text right before a name (checked in this order).
TRIGGERS = [
    (rf"(?i)\b{PROXIMITY}\s+метро\s+$", "metro"),
    (r"(?i)\bна\s+метро\s+$", "metro"),
    (r"(?i)\bметро\s+$", "metro"),
    (r"(?i)\bм\.\s+$", "metro"),
    (r"(?i)\bм\s+$", "metro"),
    (rf"(?i)\b{PROXIMITY}\s+район[ае]?\s+$", "district"),
    (r"(?i)\bв\s+районе\s+$", "district"),
    (r"(?i)\bрайон\s+$", "district"),
    (rf"(?i)\b{PROXIMITY}\s+округ[ае]?\s+$", "county"),
    (r"(?i)\bокруг\s+$", "county"),
    (r"(?i)\bв\s+юзао\s+$", "county"),
    (r"(?i)\bв\s+жк\s+$", "complex"),
    (r"(?i)\bжк\s+$", "complex"),
]
NAMES_NEEDING_MARKER = ["университет", "аэропорт", "технопарк", "деловой центр"]
STATION_MARKER_WORDS = ["метро", "м", "станция", "станции", "ст"]
