"""Schemas and fixed vocabularies of the report model."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations and display labels of the report model.
CATEGORIES = [
    "roads", "water", "electricity", "sanitation", "healthcare", "internet",
    "drainage", "education", "transport", "safety", "other",
]
LANGUAGES = ["en", "hi", "bn", "ta", "te", "mr", "gu", "kn", "ml", "pa", "or", "hi-Latn", "pt", "ru"]
COUNTED_LANGUAGES = ["en", "hi", "bn", "ta", "te", "mr", "gu", "kn", "ml", "pa", "pt", "ru"]
SOURCES = ["text", "voice", "messaging"]
STATUSES = ["submitted", "reviewing", "in_progress", "resolved"]
URGENCIES = ["low", "medium", "high", "emergency"]
DURATIONS = ["under_1_week", "1_to_4_weeks", "1_to_6_months", "over_6_months"]
SCALES = ["me", "street", "neighbourhood", "wide_area"]
MODEL_CATEGORIES = ["roads", "water", "electricity", "sanitation", "healthcare", "internet"]
MODEL_LANGUAGE_TAGS = {
    "en-IN": "en", "hi-IN": "hi", "bn-IN": "bn", "ta-IN": "ta", "te-IN": "te", "mr-IN": "mr",
    "gu-IN": "gu", "kn-IN": "kn", "ml-IN": "ml", "pa-IN": "pa", "pt-BR": "pt", "ru-RU": "ru",
}
CATEGORY_LABELS = {
    "roads": "Roads & potholes",
    "water": "Water supply",
    "electricity": "Electricity & streetlights",
    "sanitation": "Sanitation & garbage",
    "healthcare": "Healthcare",
    "internet": "Internet",
    "drainage": "Drainage & sewage",
    "education": "Education",
    "transport": "Public transport",
    "safety": "Public safety",
    "other": "Other",
}
STATUS_LABELS = {
    "submitted": "Submitted", "reviewing": "Reviewing", "in_progress": "In progress", "resolved": "Resolved",
}
CLASSIFIER_LABELS = {"user": "Manual", "trie": "Keyword", "model": "AI", "fallback": "Default"}
SCALE_LABELS = {
    "me": "Just me", "street": "My street", "neighbourhood": "Neighbourhood", "wide_area": "Whole area",
}
URGENCY_LABELS = {"low": "Low", "medium": "Medium", "high": "High", "emergency": "Emergency"}
DURATION_LABELS = {
    "under_1_week": "Less than a week", "1_to_4_weeks": "1 to 4 weeks",
    "1_to_6_months": "1 to 6 months", "over_6_months": "More than 6 months",
}
PROJECT_PHRASES = {
    "roads": "targeted road rehabilitation and drainage upgrades",
    "water": "a water-network repair and leak-reduction program",
    "electricity": "a distribution-grid reliability and transformer upgrade",
    "sanitation": "a neighborhood waste collection and sewer maintenance program",
    "healthcare": "a primary-care clinic capacity and essential-medicines project",
    "internet": "a last-mile broadband and public-connectivity expansion",
    "drainage": "a storm-drain and flood-prevention overhaul",
    "education": "a school modernization and capacity-building initiative",
    "transport": "a transit-routing and mobility-safety project",
    "safety": "a community-safety lighting and policing initiative",
    "other": "a generalized community infrastructure improvement program",
}
STATE_ALIASES = {
    "national capital territory of delhi": "delhi",
    "nct of delhi": "delhi",
    "orissa": "odisha",
    "pondicherry": "puducherry",
}
# Address fields in the order in which they are tried.
ADDRESS_FIELDS = ["state_district", "district", "county", "city_district", "municipality", "city", "town"]

# Formats of ids and telephone numbers; the whole value must match.
REFERENCE_ID_PATTERN = r"^CP-\d{4}-\d{6}\z"
PHONE_PATTERN = r"^[6-9]\d{9}\z"
DISTRICT_ID_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*__[a-z0-9]+(-[a-z0-9]+)*\z"

# Keyword dictionary (phrase, category, language); the first entry of a phrase wins.
KEYWORDS = [
    ("road", "roads", "en"), ("roads", "roads", "en"), ("pothole", "roads", "en"), ("potholes", "roads", "en"),
    ("gadhe", "roads", "hi"), ("gadde", "roads", "hi"),
    ("सड़क", "roads", "hi"), ("सड़कों", "roads", "hi"), ("गड्ढा", "roads", "hi"), ("गड्ढे", "roads", "hi"),
    ("রাস্তা", "roads", "bn"), ("সড়ক", "roads", "bn"), ("গর্ত", "roads", "bn"),
    ("சாலை", "roads", "ta"), ("சாலைகள்", "roads", "ta"), ("பள்ளம்", "roads", "ta"),
    ("estrada", "roads", "pt"), ("rodovia", "roads", "pt"), ("buraco", "roads", "pt"), ("buracos", "roads", "pt"),
    ("дорога", "roads", "ru"), ("дороги", "roads", "ru"), ("яма", "roads", "ru"), ("ямы", "roads", "ru"),
    ("water", "water", "en"), ("tap", "water", "en"),
    ("पानी", "water", "hi"), ("जल", "water", "hi"),
    ("পানি", "water", "bn"), ("জল", "water", "bn"),
    ("தண்ணீர்", "water", "ta"), ("குடிநீர்", "water", "ta"),
    ("água", "water", "pt"), ("abastecimento", "water", "pt"),
    ("вода", "water", "ru"), ("водоснабжение", "water", "ru"),
    ("electricity", "electricity", "en"), ("power", "electricity", "en"), ("outage", "electricity", "en"),
    ("बिजली", "electricity", "hi"), ("ऊर्जा", "electricity", "hi"),
    ("streetlight", "electricity", "en"), ("streetlights", "electricity", "en"),
    ("streetlight is not working", "electricity", "en"),
    ("street light", "electricity", "en"), ("street lights", "electricity", "en"),
    ("বিদ্যুৎ", "electricity", "bn"),
    ("மின்சாரம்", "electricity", "ta"), ("மின்வெட்டு", "electricity", "ta"),
    ("energia", "electricity", "pt"), ("eletricidade", "electricity", "pt"),
    ("электричество", "electricity", "ru"), ("свет", "electricity", "ru"),
    ("sanitation", "sanitation", "en"), ("garbage", "sanitation", "en"), ("sewer", "sanitation", "en"),
    ("कचरा", "sanitation", "hi"), ("स्वच्छता", "sanitation", "hi"),
    ("আবর্জনা", "sanitation", "bn"), ("নর্দমা", "sanitation", "bn"),
    ("குப்பை", "sanitation", "ta"), ("கழிவு", "sanitation", "ta"),
    ("lixo", "sanitation", "pt"), ("esgoto", "sanitation", "pt"),
    ("мусор", "sanitation", "ru"), ("канализация", "sanitation", "ru"),
    ("healthcare", "healthcare", "en"), ("hospital", "healthcare", "en"), ("clinic", "healthcare", "en"),
    ("अस्पताल", "healthcare", "hi"), ("स्वास्थ्य", "healthcare", "hi"),
    ("হাসপাতাল", "healthcare", "bn"), ("চিকিৎসা", "healthcare", "bn"),
    ("மருத்துவமனை", "healthcare", "ta"), ("மருத்துவம்", "healthcare", "ta"),
    ("saúde", "healthcare", "pt"), ("clínica", "healthcare", "pt"),
    ("больница", "healthcare", "ru"), ("медицина", "healthcare", "ru"),
    ("internet", "internet", "en"), ("wifi", "internet", "en"), ("broadband", "internet", "en"),
    ("इंटरनेट", "internet", "hi"), ("नेटवर्क", "internet", "hi"),
    ("ইন্টারনেট", "internet", "bn"), ("নেটওয়ার্ক", "internet", "bn"),
    ("இணையம்", "internet", "ta"), ("வலைப்பின்னல்", "internet", "ta"),
    ("internet", "internet", "pt"), ("conexão", "internet", "pt"),
    ("интернет", "internet", "ru"), ("связь", "internet", "ru"),
]

# Tokens that mark Hindi written in Latin letters.
ROMANISED_HINDI = (
    "hai hain nahi nahin ka ki ke mein me par pe se bahut paani pani sadak bijli gadha gadhe bade gaadi "
    "nikalna mushkil kachra kab kya koi raha rahi rahe hum aap ko ho tha thi"
).split()

# Unicode blocks (as character ranges), language code and label.
SCRIPT_BLOCKS = [
    ("\\u0900-\\u097F", "hi", "Hindi"),
    ("\\u0980-\\u09FF", "bn", "Bengali"),
    ("\\u0A00-\\u0A7F", "pa", "Punjabi"),
    ("\\u0A80-\\u0AFF", "gu", "Gujarati"),
    ("\\u0B00-\\u0B7F", "or", "Odia"),
    ("\\u0B80-\\u0BFF", "ta", "Tamil"),
    ("\\u0C00-\\u0C7F", "te", "Telugu"),
    ("\\u0C80-\\u0CFF", "kn", "Kannada"),
    ("\\u0D00-\\u0D7F", "ml", "Malayalam"),
    ("A-Za-z", "en", "English"),
]
SCRIPT_LABELS = {code: label for _, code, label in SCRIPT_BLOCKS} | {"hi-Latn": "Hinglish"}

# Scripts in the order in which they are looked for, with their language.
SCRIPT_ORDER = [
    ("IsDevanagari", "hi"), ("IsBengali", "bn"), ("IsTamil", "ta"), ("IsTelugu", "te"), ("IsGujarati", "gu"),
    ("IsKannada", "kn"), ("IsMalayalam", "ml"), ("IsGurmukhi", "pa"), ("IsCyrillic", "ru"),
]

COMPLAINT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("userId", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rawText", T.StringType()),
        T.StructField("translatedText", T.StringType()),
        T.StructField("detectedLanguage", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("classifiedBy", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("severity", T.IntegerType()),
        T.StructField("districtId", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("userCategory", T.StringType()),
        T.StructField("urgency", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("affectedScale", T.StringType()),
        T.StructField("landmark", T.StringType()),
        T.StructField("stateName", T.StringType()),
        T.StructField("photoUrls", T.ArrayType(T.StringType())),
        T.StructField("contactPhone", T.StringType()),
        T.StructField("isAnonymous", T.BooleanType()),
        T.StructField("referenceId", T.StringType()),
    ]
)

DISTRICT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("infraScore", T.DoubleType()),
        T.StructField("population", T.LongType()),
    ]
)

ADMIN_CATALOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lgdCode", T.StringType()),
        T.StructField(
            "districts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("stateId", T.StringType()),
                        T.StructField("lgdCode", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
