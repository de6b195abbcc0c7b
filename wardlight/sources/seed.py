"""Seed and benchmark data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight import domain

# Seed districts (id, name, state, lat, lng, population, infraScore), all in India.
SEED_DISTRICTS = [
    ("rajasthan__jaipur", "Jaipur", "Rajasthan", 26.9124, 75.7873, 6626178, 6.4),
    ("rajasthan__jodhpur", "Jodhpur", "Rajasthan", 26.2389, 73.0243, 3687165, 5.9),
    ("rajasthan__udaipur", "Udaipur", "Rajasthan", 24.5854, 73.7125, 3068420, 6.2),
    ("maharashtra__pune", "Pune", "Maharashtra", 18.5204, 73.8567, 9429408, 7.2),
    ("maharashtra__mumbai-suburban", "Mumbai Suburban", "Maharashtra", 19.153, 72.875, 9356962, 7.4),
    ("maharashtra__nagpur", "Nagpur", "Maharashtra", 21.1458, 79.0882, 4653570, 6.6),
    ("uttar-pradesh__lucknow", "Lucknow", "Uttar Pradesh", 26.8467, 80.9462, 4589838, 6.1),
    ("uttar-pradesh__varanasi", "Varanasi", "Uttar Pradesh", 25.3176, 82.9739, 3676841, 5.8),
    ("uttar-pradesh__kanpur-nagar", "Kanpur Nagar", "Uttar Pradesh", 26.4499, 80.3319, 4581268, 5.7),
    ("bihar__patna", "Patna", "Bihar", 25.5941, 85.1376, 5838465, 5.6),
    ("bihar__gaya", "Gaya", "Bihar", 24.7914, 85.0002, 4391418, 5.3),
    ("west-bengal__kolkata", "Kolkata", "West Bengal", 22.5726, 88.3639, 4496694, 7.1),
    ("west-bengal__darjeeling", "Darjeeling", "West Bengal", 27.036, 88.2627, 1846823, 6.3),
    ("tamil-nadu__chennai", "Chennai", "Tamil Nadu", 13.0827, 80.2707, 4646732, 7.3),
    ("tamil-nadu__madurai", "Madurai", "Tamil Nadu", 9.9252, 78.1198, 3038252, 6.2),
    ("tamil-nadu__coimbatore", "Coimbatore", "Tamil Nadu", 11.0168, 76.9558, 3458045, 7.1),
    ("kerala__ernakulam", "Ernakulam (Kochi)", "Kerala", 9.9312, 76.2673, 3282388, 7.6),
    ("kerala__thiruvananthapuram", "Thiruvananthapuram", "Kerala", 8.5241, 76.9366, 3301427, 7.5),
    ("karnataka__bengaluru-urban", "Bengaluru Urban", "Karnataka", 12.9716, 77.5946, 9621551, 7.4),
    ("karnataka__mysuru", "Mysuru", "Karnataka", 12.2958, 76.6394, 3001127, 6.8),
    ("telangana__hyderabad", "Hyderabad", "Telangana", 17.385, 78.4867, 3943323, 7.2),
    ("andhra-pradesh__visakhapatnam", "Visakhapatnam", "Andhra Pradesh", 17.6868, 83.2185, 4288113, 6.8),
    ("odisha__khordha", "Khordha (Bhubaneswar)", "Odisha", 20.2961, 85.8245, 2251673, 6.5),
    ("assam__kamrup-metro", "Kamrup Metro", "Assam", 26.1445, 91.7362, 1253938, 6.1),
    ("punjab__amritsar", "Amritsar", "Punjab", 31.634, 74.8723, 2490656, 6.7),
    ("gujarat__ahmadabad", "Ahmadabad", "Gujarat", 23.0225, 72.5714, 7214225, 7.2),
]

# Seed sentences per language, in the order of domain.MODEL_CATEGORIES.
SEED_SENTENCES = {
    "en": [
        "Potholes on the main road remain unrepaired.",
        "Water supply is irregular in this neighborhood.",
        "Frequent power cuts are disrupting daily work.",
        "Garbage has not been collected from the street.",
        "The local clinic needs staff and essential medicines.",
        "Mobile internet connectivity is unreliable in this area.",
    ],
    "hi": [
        "मुख्य सड़क के गड्ढों की मरम्मत नहीं हुई है।",
        "इस मोहल्ले में पानी की आपूर्ति अनियमित है।",
        "बार-बार बिजली कटने से रोज़मर्रा का काम प्रभावित है।",
        "सड़क से कचरा नहीं उठाया गया है।",
        "स्थानीय क्लिनिक में कर्मचारी और ज़रूरी दवाइयाँ चाहिए।",
        "इस इलाके में मोबाइल इंटरनेट ठीक से नहीं चलता।",
    ],
    "bn": [
        "প্রধান সড়কের গর্তগুলো এখনও মেরামত করা হয়নি।",
        "এই এলাকায় পানীয় জলের সরবরাহ অনিয়মিত।",
        "ঘন ঘন বিদ্যুৎ বিভ্রাটে দৈনন্দিন কাজ ব্যাহত হচ্ছে।",
        "রাস্তা থেকে আবর্জনা সংগ্রহ করা হয়নি।",
        "স্থানীয় ক্লিনিকে কর্মী ও প্রয়োজনীয় ওষুধ দরকার।",
        "এই এলাকায় মোবাইল ইন্টারনেট সংযোগ নির্ভরযোগ্য নয়।",
    ],
    "ta": [
        "முக்கிய சாலையில் உள்ள பள்ளங்கள் இன்னும் சரிசெய்யப்படவில்லை.",
        "இந்தப் பகுதியில் குடிநீர் விநியோகம் சீராக இல்லை.",
        "அடிக்கடி மின்வெட்டு ஏற்படுவதால் அன்றாடப் பணி பாதிக்கப்படுகிறது.",
        "தெருவிலிருந்து குப்பை அகற்றப்படவில்லை.",
        "உள்ளூர் மருத்துவமனைக்கு பணியாளர்களும் அத்தியாவசிய மருந்துகளும் தேவை.",
        "இந்தப் பகுதியில் கைப்பேசி இணைய இணைப்பு நம்பகமாக இல்லை.",
    ],
}


def seed_districts(spark: SparkSession) -> DataFrame:
    rows = [(i, n, "India", s, lat, lng, infra, pop) for i, n, s, lat, lng, pop, infra in SEED_DISTRICTS]
    return spark.createDataFrame(rows, domain.DISTRICT)


def gen_seed(districts: DataFrame, order: str = "ord") -> DataFrame:
    """Four reports per district; ``order`` counts the districts from 0."""
    d, i = F.col(order), F.col("i")
    category = ((d + i) % 6).cast("int")
    language = ((d + i) % 4).cast("int")
    sentences = F.array(*[F.array(*[F.lit(s) for s in group]) for group in SEED_SENTENCES.values()])
    codes = F.array(*[F.lit(c) for c in SEED_SENTENCES])
    return districts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.concat(F.lit("demo-"), "id", F.lit("-"), (i + 1).cast("string")).alias("id"),
        F.lit(None).cast("string").alias("userId"),
        F.lit("submitted").alias("status"),
        sentences[language][category].alias("rawText"),
        sentences[0][category].alias("translatedText"),
        codes[language].alias("detectedLanguage"),
        F.array(*[F.lit(c) for c in domain.MODEL_CATEGORIES])[category].alias("category"),
        ((d + i) % 5 + 1).cast("int").alias("severity"),
        F.col("id").alias("districtId"), "lat", "lng",
        F.date_add(F.lit("2025-01-01").cast("date"), (d * 4 + i).cast("int")).cast("timestamp").alias("timestamp"),
        F.array(*[F.lit(s) for s in domain.SOURCES])[i % 3].alias("source"),
    )


def gen_benchmark(spark: SparkSession, n: int = 100_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(reports, districts) spread evenly over the globe, for timing."""

    def uniform(low: float, high: float, offset: int):
        return F.lit(low) + F.rand(seed + offset) * F.lit(high - low)

    names = F.array(*[F.lit(c) for c in domain.MODEL_CATEGORIES])
    reports = spark.range(n).select(
        F.col("id").alias("ord"), F.col("id").cast("string").alias("id"),
        names[(F.col("id") % 6).cast("int")].alias("category"),
        F.concat(F.lit("district-"), (F.col("id") % 100).cast("string")).alias("districtId"),
        uniform(-55.0, 70.0, 0).alias("lat"), uniform(-170.0, 170.0, 1).alias("lng"),
        (F.col("id") % 5 + 1).cast("int").alias("severity"),
    )
    districts = spark.range(100).select(
        F.col("id").alias("ord"), F.concat(F.lit("district-"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("District "), F.col("id").cast("string")).alias("name"), F.lit("Unknown").alias("country"),
        F.lit(None).cast("string").alias("state"), uniform(-55.0, 70.0, 2).alias("lat"),
        uniform(-170.0, 170.0, 3).alias("lng"), (F.lit(1.0) + F.col("id") % 10).alias("infraScore"),
        F.lit(None).cast("long").alias("population"),
    )
    return reports, districts
