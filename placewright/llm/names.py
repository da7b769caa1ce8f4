"""Normal forms of typed business and person names."""

from __future__ import annotations

import re
from functools import lru_cache

from placewright.llm.postal import fold

#: Legal forms and their abbreviations, words commonly shortened in business names, and nicknames of given names.
LEGAL = {"llc", "inc", "incorporated", "ltd", "limited", "corp", "corporation", "pllc", "plc", "lp", "llp", "pc", "pa", "co", "company", "companies", "dba", "gmbh"}
SHORT = {
    "svc": "services", "svcs": "services", "service": "services", "serv": "services", "srv": "services", "ctr": "center", "cntr": "center", "cent": "center", "centre": "center", "assoc": "associates", "assocs": "associates", "associate": "associates", "assc": "associates",
    "acctg": "accounting", "acct": "accounting", "accting": "accounting", "bros": "brothers", "bro": "brothers", "mkt": "market", "rest": "restaurant", "vet": "veterinary", "hosp": "hospital", "elec": "electric", "electrical": "electric", "plbg": "plumbing", "htg": "heating", "constr": "construction",
    "mgmt": "management", "grp": "group", "ofc": "office", "off": "office", "med": "medical", "dent": "dental", "fam": "family", "intl": "international", "natl": "national", "mfg": "manufacturing", "mt": "mount", "st": "saint", "dept": "department", "chiro": "chiropractic", "landscpg": "landscaping", "ldscp": "landscaping", "auto": "automotive",
    "clnc": "clinic", "rd": "road", "shoppe": "shop", "repr": "repair", "rep": "repair", "exterm": "exterminating", "mvg": "moving", "stor": "storage", "stge": "storage", "hse": "house", "kit": "kitchen", "kitch": "kitchen", "bkry": "bakery", "gdn": "garden", "grdn": "garden", "solns": "solutions", "sol": "solutions", "roof": "roofing", "rfg": "roofing", "cafe": "coffee",
    "roofg": "roofing", "lndscpg": "landscaping", "lndscp": "landscaping", "brbr": "barber", "acctng": "accounting", "bkkpg": "bookkeeping", "elect": "electric", "svce": "services",
}
NICKNAMES = {
    "andy": "andrew", "drew": "andrew", "bill": "william", "will": "william", "billy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "dick": "richard", "rick": "richard", "rich": "richard", "jim": "james", "jimmy": "james", "jamie": "james", "joe": "joseph", "joey": "joseph",
    "mike": "michael", "mick": "michael", "mickey": "michael", "tom": "thomas", "tommy": "thomas", "dave": "david", "davy": "david", "dan": "daniel", "danny": "daniel", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "chris": "christopher", "kit": "christopher", "topher": "christopher", "tony": "anthony", "nick": "nicholas", "nicky": "nicholas", "matt": "matthew", "steve": "stephen", "steven": "stephen", "stephan": "stephen",
    "sam": "samantha", "sammy": "samantha", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "libby": "elizabeth", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "cathy": "katherine", "catherine": "katherine", "kay": "katherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "sue": "susan", "susie": "susan", "suzy": "susan", "debbie": "deborah", "deb": "deborah", "debra": "deborah",
    "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "barb": "barbara", "becky": "rebecca", "becca": "rebecca", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "abby": "abigail", "abbie": "abigail", "gail": "abigail", "alex": "alexandra", "sandra": "alexandra", "lexi": "alexandra", "sasha": "alexandra", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "hank": "henry", "harry": "henry", "hal": "henry", "chuck": "charles", "charlie": "charles", "charley": "charles", "chas": "charles", "greg": "gregory", "gregg": "gregory", "jerry": "gerald", "gerry": "gerald", "larry": "lawrence", "lars": "lawrence", "laurie": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "ray": "raymond", "ron": "ronald", "ronnie": "ronald", "ronny": "ronald", "tim": "timothy", "timmy": "timothy", "vince": "vincent", "vinny": "vincent", "vin": "vincent", "walt": "walter", "zach": "zachary", "zack": "zachary", "zac": "zachary", "gene": "eugene",
    "ellie": "eleanor", "nell": "eleanor", "nora": "eleanor", "lena": "eleanor", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "lola": "dolores", "lolly": "dolores", "mina": "wilhelmina", "billie": "wilhelmina", "willa": "wilhelmina", "minnie": "wilhelmina", "tina": "bettina", "misha": "mikhail", "nacho": "ignacio", "iggy": "ignacio", "paco": "francisco", "pancho": "francisco", "frank": "francisco", "fritz": "frederick", "sally": "sarah", "benjy": "benjamin", "pepe": "jose", "lupe": "guadalupe", "lupita": "guadalupe", "hannes": "johannes", "hans": "johannes", "ollie": "oliver", "gabe": "gabriel", "nate": "nathaniel", "nat": "nathaniel", "josh": "joshua", "jon": "jonathan", "johnny": "john", "jack": "john",
    "phil": "philip", "stu": "stuart", "al": "albert", "bert": "albert", "art": "arthur", "artie": "arthur", "don": "donald", "donnie": "donald", "doug": "douglas", "ken": "kenneth", "kenny": "kenneth", "jeff": "jeffrey", "geoff": "jeffrey", "pete": "peter", "max": "maximilian", "mary": "mary", "molly": "mary", "polly": "mary", "cindy": "cynthia", "angie": "angela", "connie": "constance", "fran": "frances", "ginny": "virginia", "jackie": "jacqueline", "judy": "judith", "mandy": "amanda", "nan": "nancy", "roz": "rosalind", "steph": "stephanie", "terry": "theresa", "tess": "theresa", "val": "valerie", "viv": "vivian", "xander": "alexander", "raj": "rajesh", "keish": "keisha", "ingie": "ingrid", "renny": "renee", "charlotte": "charlotte", "lottie": "charlotte", "ozzie": "oscar", "jules": "julian",
}
GIVEN = set(NICKNAMES.values()) | set(
    "amara wei linh kofi noor yusuf chiara oksana soren hana omar thiago priya zoe renee ingrid keisha samantha james mary john patricia jennifer linda david susan jessica sarah karen lisa nancy betty sandra ashley emily kimberly donna michelle carol amanda melissa laura amy "
    "anna emma olivia sophia lucas noah ethan mason logan aiden jackson carlos luis juan miguel pedro ana maria elena lucia ali ahmed fatima mohammed hassan aisha chen li yang ming yuki kenji sakura hiroshi raj anil sunita deepa ivan olga natasha dmitri igor pierre claire hans klaus greta lars".split()
)
HONORIFICS = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "mx", "rev", "hon", "attorney", "chef"}
CREDENTIALS = {"md", "dds", "dmd", "do", "dc", "dvm", "vmd", "phd", "esq", "cpa", "jd", "rn", "np", "pa", "od", "mba", "jr", "sr", "ii", "iii", "iv", "ea", "lcsw", "owner", "founder", "ceo"}
NO_PERSON = {"owner", "staff", "team", "admin", "manager", "office", "info", "support", "customer", "unknown", "none", "n/a", "na", "tbd", "the", "management", "reception", "front", "desk", "sales", "contact", "service", "department", "anonymous"}


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


@lru_cache(50_000)
def _nearly(word: str, target: str) -> bool:
    """A long word with few letters wrong: same first letter, at most two letters missing, added or out of place."""
    if word[:1] != target[:1] or abs(len(word) - len(target)) > 2 or len(word) < 5:
        return False
    rest = list(target)
    extra = 0
    for c in word:
        if c in rest:
            rest.remove(c)
        else:
            extra += 1
    return extra + len(rest) <= 2 and (word[-1] == target[-1] or word[:3] == target[:3])


def business_tokens(name: str | None) -> list[str]:
    """Words of a business name in their usual order: advertising tails, store numbers, legal forms and the article dropped, abbreviations written out."""
    raw = name or ""
    raw = re.split(r"\s+[|•·*–—\-]\s+", raw)[0]
    raw = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", raw) if "(" in raw or "[" in raw else raw
    raw = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", raw) if not raw.isupper() else raw
    text = fold(raw).replace("’", "'")
    text = re.sub(r"\b((?:[a-z]\.\s?){2,})", lambda m: m.group().replace(".", "").replace(" ", "") + " ", text) if "." in text and re.search(r"\b(?:l\.\s?l\.\s?c|p\.\s?l\.\s?l\.\s?c|l\.\s?p|p\.\s?c|p\.\s?a|l\.\s?l\.\s?p)\.", text) else text
    text = re.sub(r"#\s*\d+|\b(?:no|store|unit)\.?\s*\d+\s*$", " ", text)
    text = text.replace("&", " and ").replace("+", " and ").replace("'", "")
    parts = [p.strip() for p in text.split(",") if p.strip()]
    parts = [p for p in parts if any(w not in LEGAL for w in _words(p))] or parts
    if len(parts) == 2:
        parts = parts[::-1]
    words = [SHORT.get(w, w) for p in parts for w in _words(p)]
    words = [NICKNAMES.get(w, NICKNAMES.get(w[:-1], "") + "s" if w.endswith("s") and w[:-1] in NICKNAMES else w) for w in words]
    kept = [w for w in words if w not in LEGAL and w not in {"the", "and"} and not (w[0] == "c" and _nearly(w, "company"))]
    return kept or [w for w in words if w not in {"the", "and"}] or words


@lru_cache(50_000)
def _skeleton(word: str) -> str:
    return word[:1] + re.sub(r"[aeiou]", "", word[1:])


def business_forms(name: str | None, initials: bool = True) -> list[str]:
    """Spellings under which a business name is looked up, each with its role in the first letter (d only with ``initials``).

    n: words in usual order, and sorted; k: without vowels, for shortened words; a: as typed with leading initials;
    d: leading words of a full name shortened to the initials they might be typed as. Forms a and d begin with "~".
    """
    words = business_tokens(name)
    forms = _word_forms(words)
    if initials and words and not any(f[0] == "a" for f in forms):
        forms += ["d" + f for f in initial_forms(words)]
    return list(dict.fromkeys(forms))


def _word_forms(words: list[str]) -> list[str]:
    if not words:
        return []
    forms = ["n" + "".join(words), "n" + "".join(sorted(words))]
    bones = "".join(_skeleton(w) for w in words)
    if len(bones) >= 8:
        forms.append("k" + bones)
    single = 0
    while single < len(words) and len(words[single]) == 1:
        single += 1
    if single >= 2:
        forms.append("a~" + "".join(words[:single]) + "~" + "".join(words[single:]))
        if words[0] == "t":  # the article's initial
            forms.append("a~" + "".join(words[1:single]) + "~" + "".join(words[single:]))
    return forms


def initial_forms(words: list[str]) -> list[str]:
    """The texts of forms d of a full name."""
    return ["~" + "".join(w[0] for w in words[:n]) + "~" + "".join(words[n:]) for n in range(1, min(len(words), 5) + 1)]


def listing_forms(names: list[str]) -> list[str]:
    """Forms n, k and a of all names of a listing, and for full names w: their words, of which :func:`initial_forms` makes forms d where these are needed."""
    out: list[str] = []
    for name in names:
        words = business_tokens(name)
        forms = _word_forms(words)
        out += forms
        if words and not any(f[0] == "a" for f in forms):
            out.append("w" + " ".join(words))
    return list(dict.fromkeys(out))


def person(name: str | None) -> list[tuple[str, str, str, str]]:
    """(given, middle initial, family, suffix) of a written name: titles and credentials dropped, "Last, First" turned round,
    nicknames written out; given may be one letter or empty. Two readings where the order cannot be told, none for no name."""
    text = re.sub(r"\([^)]*\)|\"[^\"]*\"", " ", fold(name).replace("’", "'").replace("'", ""))
    parts, suffix = [], ""
    for p in re.split(r"[,;/|]", text):
        words = re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", p)
        for w in words:
            if w in {"jr", "sr", "ii", "iii", "iv"}:
                suffix = {"ii": "jr"}.get(w, w)
        words = [w for w in words if w not in CREDENTIALS and w not in HONORIFICS]
        if words:
            parts.append(words)
    if not parts or all(w in NO_PERSON for p in parts for w in p):
        return []
    turned = len(parts) >= 2
    words = parts[1] + parts[0] if turned else parts[0]
    if turned:
        given, middle, family = parts[1][0], (parts[1][1][:1] if len(parts[1]) > 1 else ""), parts[0][-1] if len(parts[0]) == 1 else " ".join(parts[0])
        return [(NICKNAMES.get(given, given), middle, family, suffix)]
    if len(words) == 1:
        return [("", "", words[0], suffix)]
    if len(words) > 2 and len(words[-1]) == 1:  # Family Given M.
        g, f = (words[1], words[0]) if len(words) == 3 else (words[0], words[1])
        return [(NICKNAMES.get(g, g), words[-1], f, suffix)]
    given, family = words[0], words[-1]
    middle = words[1][:1] if len(words) > 2 else ""
    first = (NICKNAMES.get(given, given), middle, family, suffix)
    if len(words) == 2 and len(given) > 1:
        turned_round = (NICKNAMES.get(family, family), "", given, suffix)
        known = lambda w: w in GIVEN or w in NICKNAMES
        if known(family) and not known(given):
            return [turned_round]
        if not known(given) and not known(family):
            return [first, turned_round]
    if len(words) == 2 and len(family) == 1:
        return [(family, "", given, suffix)]
    return [first]
