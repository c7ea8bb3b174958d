"""Fixed vocabularies of land records."""

from __future__ import annotations

from dataclasses import dataclass

# Keys, kinds, whether required, and patterns of the seventeen fields.
FIELDS = (
    ("khasra_number", "number", True, r"^\d{1,5}(?:[/-]\d{1,4})*(?:\s*(?:क|ख|ग|अ|ब|[a-zA-Z]))?$"),
    ("khata_number", "number", True, r"^\d{1,6}(?:[/-]\d{1,4})?$"),
    ("survey_number", "number", False, r"^\d{1,6}(?:[/-][\dA-Za-z]{1,4})*$"),
    ("ulpin", "text", False, r"^[A-Z0-9]{14}$"),
    ("owner_name", "person", True, None),
    ("father_name", "person", False, None),
    ("share", "text", False, r"^\d{1,4}\s*/\s*\d{1,4}$|^\d{1,3}(?:\.\d+)?\s*%$"),
    ("area", "area", True, None),
    ("land_classification", "class", False, None),
    ("village", "text", True, None),
    ("tehsil", "text", False, None),
    ("district", "text", True, None),
    ("state", "text", False, None),
    ("mutation_number", "text", False, r"^[A-Za-z0-9]{1,8}(?:[/-][A-Za-z0-9]{1,6})*$"),
    ("mutation_date", "date", False, None),
    ("registration_number", "text", False, r"^[A-Za-z0-9]{1,10}(?:[/-][A-Za-z0-9]{1,6})*$"),
    ("registration_date", "date", False, None),
)


@dataclass(frozen=True)
class Field:
    key: str
    kind: str
    required: bool
    pattern: str | None


FIELD = {k: Field(k, kind, req, pat) for k, kind, req, pat in FIELDS}
REQUIRED = tuple(k for k, f in FIELD.items() if f.required)
#: One of these has to be there; the first stands for both in an issue.
IDENTIFIERS = ("khasra_number", "survey_number")

# Square metres in a unit, whether it varies by region, and the unit's spellings.
UNITS = (
    ("hectare", 10000.0, False, ("hectare", "hect", "ha", "हेक्टेयर", "हेक्टर", "হেক্টর", "ਹੈਕਟੇਅਰ", "હેક્ટર", "ஹெக்டேர்", "హెక్టారు", "ಹೆಕ್ಟೇರ್")),
    ("acre", 4046.86, False, ("acre", "एकड़", "एकड", "একর", "ਏਕੜ", "એકર", "ஏக்கர்", "ఎకరం", "ಎಕರೆ")),
    ("sqm", 1.0, False, ("sq.m", "sqm", "sq m", "square metre", "square meter", "वर्ग मीटर", "বর্গ মিটার", "ਵਰਗ ਮੀਟਰ", "ચોરસ મીટર", "சதுர மீட்டர்", "చదరపు మీటర్", "ಚದರ ಮೀಟರ್")),
    ("sqft", 0.092903, False, ("sq.ft", "sqft", "sq ft", "square feet", "वर्ग फुट", "বর্গফুট", "ਵਰਗ ਫੁੱਟ", "ચોરસ ફૂટ", "சதுர அடி", "చదరపు అడుగు", "ಚದರ ಅಡಿ")),
    ("sqyd", 0.83612736, False, ("sq.yds", "sq yds", "sqyds", "sq.yd", "sq yd", "sqyd", "square yard", "square yards", "sq.yards", "sq yards", "gaj", "गज", "गज़", "वर्ग गज", "ਗਜ਼", "ગજ")),
    ("bigha", 2529.29, True, ("bigha", "बीघा", "बिघा", "বিঘা")),
    ("biswa", 126.44, True, ("biswa", "बिस्वा", "विस्वा")),
    ("guntha", 101.17, True, ("guntha", "गुंठा", "ಗುಂಠೆ")),
    ("kanal", 505.86, True, ("kanal", "कनाल", "ਕਨਾਲ")),
    ("marla", 25.29, True, ("marla", "मरला", "ਮਰਲਾ")),
    ("cent", 40.47, True, ("cent", "सेंट", "சென்ட்", "సెంటు", "ಸೆಂಟ್")),
)
SQM = {u: f for u, f, _, _ in UNITS}
REGIONAL = tuple(u for u, _, r, _ in UNITS if r)
#: (spelling, unit), longest spelling first.
SPELLINGS = tuple(sorted(((s, u) for u, _, _, names in UNITS for s in names), key=lambda x: (-len(x[0]), x[0])))

# Land classes and the words that name them.
LAND_CLASSES = {
    "irrigated_agricultural": ("irrigated", "sinchit", "सिंचित", "nahri", "नहरी", "chahi", "चाही", "bagayat", "बागायत", "बागायती", "সেচ", "সেচযুক্ত", "ਸਿੰਚਾਈ", "સિંચાઈ", "பாசனம்", "నీటిపారుదల", "ನೀರಾವರಿ"),
    "unirrigated_agricultural": ("unirrigated", "un-irrigated", "asinchit", "असिंचित", "barani", "बारानी", "बरानी", "jirayat", "जिरायत", "जिराईत", "khushki", "खुश्की", "বৃষ্টিনির্ভর", "ਬਾਰਾਨੀ", "બિનપિયત", "மானாவாரி", "మెట్ట", "ಮಳೆಯಾಶ್ರಿತ"),
    "agricultural": ("agricultural", "agriculture", "krishi", "कृषि", "खेती", "কৃষি", "ਖੇਤੀਬਾੜੀ", "ખેતી", "விவசாயம்", "వ్యవసాయం", "ಕೃಷಿ"),
    "residential": ("residential", "abadi", "आबादी", "आवासीय", "awasiya", "gharat", "আবাসিক", "ਰਿਹਾਇਸ਼ੀ", "રહેણાંક", "குடியிருப்பு", "నివాస", "ವಸತಿ"),
    "commercial": ("commercial", "vyavsayik", "व्यावसायिक", "वाणिज्यिक", "বাণিজ্যিক", "ਵਪਾਰਕ", "વ્યાપારી", "வணிக", "వాణిజ్య", "ವಾಣಿಜ್ಯ"),
    "industrial": ("industrial", "audyogik", "औद्योगिक", "শিল্প", "ਉਦਯੋਗਿਕ", "ઔદ્યોગિક", "தொழிற்துறை", "పారిశ్రామిక", "ಕೈಗಾರಿಕಾ"),
    "barren": ("barren", "banjar", "बंजर", "parti", "परती", "usar", "ऊसर", "পতিত", "ਬੰਜਰ", "પડતર", "தரிசு", "బంజరు", "ಬಂಜರು"),
    "forest": ("forest", "van", "वन", "jungle", "जंगल", "বন", "ਜੰਗਲ", "જંગલ", "காடு", "అడవి", "ಅರಣ್ಯ"),
    "government": ("government", "sarkari", "सरकारी", "gram sabha", "ग्राम सभा", "shamlat", "সরকারি", "ਸਰਕਾਰੀ", "સરકારી", "அரசு", "ప్రభుత్వ", "ಸರ್ಕಾರಿ"),
    "water_body": ("pond", "talab", "तालाब", "nadi", "नदी", "water body", "जलाशय", "জলাশয়", "ਤਲਾਬ", "તળાવ", "குளம்", "చెరువు", "ಕೆರೆ"),
    "road": ("road", "rasta", "रास्ता", "सड़क", "path", "রাস্তা", "ਸੜਕ", "રસ્તો", "சாலை", "రోడ్డు", "ರಸ್ತೆ"),
}

# Words that mark a document type, with weights.
SIGNALS = {
    "record_of_rights": (("plot information", 4.0), ("owner details", 3.0), ("khasra", 3.0), ("खसरा", 3.0), ("khatauni", 4.0), ("खतौनी", 4.0), ("record of rights", 4.0), ("भूमि का विवरण", 4.0), ("khata no", 2.0), ("खाता", 2.0), ("गाटा", 2.0), ("land record", 2.0), ("भू-अभिलेख", 3.0), ("अधिकार अभिलेख", 4.0), ("hectare", 1.0), ("हेक्टेयर", 1.0), ("bigha", 1.0)),
    "plot_report": (("scale:", 7.0), ("plotinfo", 4.0), ("plot no", 2.0), ("भूमि का विवरण", 4.0), ("plot information", 4.0), ("owner details", 3.0), ("खसरा नंबर", 3.0), ("खसरा", 3.0), ("khata no", 2.0), ("hectare", 1.0), ("हेक्टेयर", 1.0)),
    "power_of_attorney": (("power of attorney", 5.0), ("attorney", 2.0), ("gpa", 3.0), ("मुख्तारनामा", 5.0), ("वसीयत", 1.0), ("first party", 2.0), ("second party", 2.0), ("article 48", 3.0), ("attorney holder", 3.0), ("is at liberty to sell", 2.0)),
    "sale_deed": (("sale deed", 5.0), ("बैनामा", 5.0), ("विक्रय विलेख", 5.0), ("conveyance deed", 4.0), ("vendor", 2.0), ("vendee", 2.0), ("purchaser", 1.5), ("consideration price", 2.0), ("sold and transferred", 2.0)),
    "mutation_order": (("mutation order", 5.0), ("नामांतरण", 4.0), ("दाखिल खारिज", 5.0), ("order description", 3.0), ("आदेश दिनांक", 2.0), ("तहसीलदार", 2.0), ("naib tehsildar", 2.0)),
    "stamp_certificate": (("india non judicial", 5.0), ("e-stamp", 4.0), ("certificate no", 2.0), ("stamp duty paid by", 3.0), ("unique doc. reference", 3.0), ("account reference", 2.0), ("shcilestamp", 3.0)),
}
CARRIERS = ("stamp_certificate",)
MIN_SCORE, MIN_MARGIN = 4.0, 2.0

# Values that stand for no value.
PLACEHOLDERS = ("na", "n a", "n/a", "n.a", "n.a.", "none", "nil", "unknown", "xx", "xxx", "-", "--", "not available", "to be filled", "tbd", "blank")

# Months.
ENGLISH_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
HINDI_MONTHS = (("जनवरी", 1), ("फरवरी", 2), ("मार्च", 3), ("अप्रैल", 4), ("मई", 5), ("जून", 6), ("जुलाई", 7), ("अगस्त", 8), ("सितंबर", 9), ("सितम्बर", 9), ("अक्टूबर", 10), ("नवंबर", 11), ("नवम्बर", 11), ("दिसंबर", 12), ("दिसम्बर", 12))

# The zero of each script's digits, and the scripts' code blocks.
DIGIT_ZEROS = (0x0966, 0x0AE6, 0x0A66, 0x09E6, 0x0CE6, 0x0C66, 0x0BE6)
SCRIPTS = (("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF))
