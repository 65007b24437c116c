"""Word lists, bands and weights. All of them are fixed values that results depend on."""

from __future__ import annotations

#: Padding phrases.
FILLER = [
    "it is important to note", "it should be noted", "in today's fast-paced", "in this day and age", "when it comes to",
    "at the end of the day", "needless to say", "it goes without saying", "the fact of the matter", "in order to",
    "due to the fact that", "a wide range of", "plays a vital role", "plays a crucial role", "in conclusion",
    "last but not least", "first and foremost",
]
#: Stock phrases of generated text.
TELLS = [
    "moreover", "furthermore", "additionally", "in conclusion", "it is important to note", "delve into", "navigate the",
    "tapestry", "in the realm of", "unlock the", "harness the power", "in summary", "on the other hand", "as a result",
    "underscore", "testament to", "boasts a", "elevate your", "seamless", "robust", "cutting-edge",
]
#: The shorter list of the on-page audit.
AUDIT_TELLS = TELLS[:11]

#: Stop words of the on-page audit, of the site analysis, and of content-word overlap.
AUDIT_STOP = [
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "for", "with", "as", "is", "are", "was", "were", "be", "been",
    "being", "it", "its", "this", "that", "these", "those", "at", "by", "from", "can", "may", "will", "would", "should", "could", "has",
    "have", "had", "do", "does", "did", "not", "you", "your", "we", "our", "they", "their", "he", "she", "his", "her", "i", "so", "than",
    "then", "there", "here", "what", "when", "which", "who", "how", "why", "all", "any", "more", "most", "some", "such", "no", "nor",
    "only", "own", "same", "too", "very", "just", "also", "about", "into", "over",
]
SITE_STOP = [
    "the", "a", "an", "and", "or", "of", "for", "in", "on", "to", "with", "at", "by", "from", "is", "are", "how", "what", "why", "when",
    "which", "who", "your", "you", "best", "top", "common", "guide", "complete", "know", "about", "need", "everyone", "should", "not",
    "ignore", "signs", "can", "do", "does",
]
OVERLAP_STOP = [
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "for", "with", "as", "is", "are", "was", "were", "be", "been",
    "being", "it", "its", "this", "that", "these", "those", "at", "by", "from", "can", "may", "will", "would", "should", "could", "has",
    "have", "had", "do", "does", "did", "not", "you", "your", "we", "our", "they", "their", "he", "she", "his", "her",
]

#: Weights and bands (good, bad) of the English detector.
DETECT_WEIGHTS = {"para_cv": 0.30, "tell_1k": 0.30, "colon_lists_1k": 0.25, "passive_ratio": 0.15}
DETECT_BANDS = {"para_cv": (0.18, 0.02), "tell_1k": (0.0, 5.0), "colon_lists_1k": (0.0, 5.0), "passive_ratio": (0.28, 0.04)}
DETECT_TARGET = 70.0

#: Weights of the composite human-likeness score.
COMPOSITE_WEIGHTS = {"fidelity": 0.20, "grammar": 0.22, "translationese": 0.28, "register": 0.08, "burstiness": 0.14, "native_review": 0.08}
if abs(sum(COMPOSITE_WEIGHTS.values()) - 1) > 0.001:
    raise ValueError("the weights of the composite score must add up to 1")
#: Kinds of flag that block publishing when they are errors.
BLOCKING = ["protected_span", "truncation", "empty_block", "mixed_script", "locked_term", "medical_claim", "hedge_lost"]

#: Title, description and slug lengths.
TITLE_MIN, TITLE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX, SLUG_MAX, THIN_WORDS = 30, 60, 70, 155, 75, 300

#: Target languages: name, own name, script, region, usual form of address. Fixed values.
LANGUAGES = [
    {"code": "hi", "name": "Hindi", "native": "हिन्दी", "engine": "hi", "script": "Devanagari", "region": "North India / Hindi belt", "honorific": "aap"},
    {"code": "mr", "name": "Marathi", "native": "मराठी", "engine": "mr", "script": "Devanagari", "region": "Maharashtra", "honorific": "tumhi"},
    {"code": "gu", "name": "Gujarati", "native": "ગુજરાતી", "engine": "gu", "script": "Gujarati", "region": "Gujarat", "honorific": "tame"},
    {"code": "bn", "name": "Bengali", "native": "বাংলা", "engine": "bn", "script": "Bengali", "region": "West Bengal", "honorific": "apni"},
    {"code": "ta", "name": "Tamil", "native": "தமிழ்", "engine": "ta", "script": "Tamil", "region": "Tamil Nadu", "honorific": "neengal"},
    {"code": "te", "name": "Telugu", "native": "తెలుగు", "engine": "te", "script": "Telugu", "region": "Andhra / Telangana", "honorific": "meeru"},
    {"code": "kn", "name": "Kannada", "native": "ಕನ್ನಡ", "engine": "kn", "script": "Kannada", "region": "Karnataka", "honorific": "neevu"},
    {"code": "pa", "name": "Punjabi", "native": "ਪੰਜਾਬੀ", "engine": "pa", "script": "Gurmukhi", "region": "Punjab", "honorific": "tusi"},
    {"code": "hinglish", "name": "Hinglish", "native": "Hinglish", "engine": "hi", "script": "Latin", "region": "Pan-India urban", "honorific": "aap"},
]
#: Endings of sentence-final verbs by language. Fixed values.
VERB_ENDINGS = {
    "hi": [
        "है", "हैं", "था", "थी", "थे", "हो", "हूँ", "हूं", "गा", "गी", "गे", "ता", "ती", "ते", "या", "ये", "ना", "नी",
        "ने", "कर", "चाहिए", "सकता", "सकती", "सकते", "रहा", "रही", "रहे", "दें", "करें", "जाए", "जाता", "जाती", "होता",
        "होती", "होते", "लें", "पड़ता", "पड़ती",
    ],
    "mr": [
        "आहे", "आहेत", "होता", "होती", "होते", "नाही", "करा", "करावे", "शकते", "शकतो", "जाते", "जातो", "असते", "असतो",
        "लागते", "येते", "पाहिजे", "हवे", "देते", "घ्या",
    ],
    "gu": [
        "છે", "હતું", "હતા", "હતી", "થાય", "કરો", "શકે", "શકાય", "જોઈએ", "આવે", "રહે", "હોય", "થશે", "કરવું", "લેવું",
    ],
    "bn": [
        "করে", "হয়", "ছিল", "আছে", "যায়", "করুন", "হবে", "থাকে", "পারে", "দিন", "নিন", "করছে", "হয়েছে", "উচিত",
        "যেতে",
    ],
    "ta": [
        "கிறது", "ஆகும்", "உள்ளது", "வேண்டும்", "இருக்கும்", "படும்", "செய்யுங்கள்", "முடியும்", "இல்லை", "ஆகிறது",
        "வரும்", "தரும்",
    ],
    "te": [
        "ఉంది", "అవుతుంది", "చేయండి", "ఉన్నాయి", "కావచ్చు", "చేస్తుంది", "ఇస్తుంది", "రావచ్చు", "లేదు", "ఉంటుంది",
        "కలదు", "చేయాలి",
    ],
    "kn": [
        "ಇದೆ", "ಆಗುತ್ತದೆ", "ಮಾಡಿ", "ಬಹುದು", "ಇವೆ", "ಆಗಿದೆ", "ನೀಡುತ್ತದೆ", "ಇಲ್ಲ", "ಇರುತ್ತದೆ", "ಮಾಡಬೇಕು", "ಬರುತ್ತದೆ",
    ],
    "pa": [
        "ਹੈ", "ਹਨ", "ਸੀ", "ਕਰੋ", "ਸਕਦਾ", "ਸਕਦੀ", "ਸਕਦੇ", "ਚਾਹੀਦਾ", "ਹੁੰਦਾ", "ਹੁੰਦੀ", "ਜਾਂਦਾ", "ਰਿਹਾ", "ਦਿਓ", "ਲਵੋ",
    ],
    "hinglish": [
        "hai", "hain", "tha", "thi", "the", "hoga", "hogi", "karein", "sakta", "sakti", "sakte", "raha", "rahi",
        "rahe", "chahiye", "jata", "jati", "hota", "hoti",
    ],
}
#: Connectives that generated prose leans on, by language. Fixed values.
CONNECTIVES = {
    "hi": [
        "इसके अलावा", "इसके अतिरिक्त", "हालांकि", "इसलिए", "साथ ही", "दूसरी ओर", "निष्कर्ष के तौर पर",
        "यह ध्यान देने योग्य है", "महत्वपूर्ण है कि", "इस प्रकार", "अंततः", "सबसे पहले", "इसके फलस्वरूप", "उपरोक्त",
        "निम्नलिखित",
    ],
    "mr": [
        "याशिवाय", "तथापि", "म्हणून", "त्याचप्रमाणे", "दुसरीकडे", "निष्कर्षानुसार", "हे लक्षात घेणे महत्त्वाचे",
        "अशा प्रकारे", "शेवटी",
    ],
    "gu": [
        "વધુમાં", "જોકે", "તેથી", "તે ઉપરાંત", "બીજી બાજુ", "નિષ્કર્ષમાં", "એ નોંધવું મહત્વપૂર્ણ છે", "આ રીતે", "અંતે",
    ],
    "bn": [
        "এছাড়াও", "তবে", "অতএব", "উপরন্তু", "অন্যদিকে", "উপসংহারে", "এটি লক্ষ্য করা গুরুত্বপূর্ণ", "এইভাবে",
        "পরিশেষে",
    ],
    "ta": [
        "மேலும்", "இருப்பினும்", "எனவே", "கூடுதலாக", "மறுபுறம்", "முடிவாக", "இது குறிப்பிடத்தக்கது", "இவ்வாறு",
        "இறுதியாக",
    ],
    "te": [
        "అదనంగా", "అయితే", "కాబట్టి", "ఇంకా", "మరోవైపు", "ముగింపులో", "ఇది గమనించడం ముఖ్యం", "ఈ విధంగా", "చివరగా",
    ],
    "kn": [
        "ಇದಲ್ಲದೆ", "ಆದಾಗ್ಯೂ", "ಆದ್ದರಿಂದ", "ಜೊತೆಗೆ", "ಮತ್ತೊಂದೆಡೆ", "ಕೊನೆಯಲ್ಲಿ", "ಇದನ್ನು ಗಮನಿಸುವುದು ಮುಖ್ಯ", "ಈ ರೀತಿಯಾಗಿ",
    ],
    "pa": [
        "ਇਸ ਤੋਂ ਇਲਾਵਾ", "ਹਾਲਾਂਕਿ", "ਇਸ ਲਈ", "ਨਾਲ ਹੀ", "ਦੂਜੇ ਪਾਸੇ", "ਸਿੱਟੇ ਵਜੋਂ", "ਇਹ ਧਿਆਨ ਦੇਣ ਯੋਗ ਹੈ", "ਇਸ ਤਰ੍ਹਾਂ",
    ],
    "hinglish": [
        "iske alawa", "halanki", "isliye", "saath hi", "doosri or", "nishkarsh", "is prakar", "antatah",
    ],
}
#: Literal renderings of English constructions, by language. Fixed values.
CALQUES = {
    "hi": [
        "यह ध्यान देने योग्य है कि", "के संदर्भ में", "के मामले में", "एक बार जब", "के रूप में जाना जाता है",
        "यह कहा जा सकता है कि", "के संबंध में", "इस तथ्य के कारण", "यह सुनिश्चित करें कि", "की एक विस्तृत श्रृंखला",
        "में एक महत्वपूर्ण भूमिका निभाता है", "जब बात आती है", "अपने आप में", "दिन के अंत में",
    ],
    "mr": [
        "हे लक्षात घेणे महत्त्वाचे आहे की", "च्या संदर्भात", "च्या बाबतीत", "म्हणून ओळखले जाते",
        "एक महत्त्वाची भूमिका बजावते", "ची विस्तृत श्रेणी",
    ],
    "gu": [
        "એ નોંધવું જોઈએ કે", "ના સંદર્ભમાં", "ના કિસ્સામાં", "તરીકે ઓળખાય છે", "મહત્વપૂર્ણ ભૂમિકા ભજવે છે",
    ],
    "bn": [
        "এটি লক্ষণীয় যে", "এর প্রসঙ্গে", "এর ক্ষেত্রে", "হিসাবে পরিচিত", "গুরুত্বপূর্ণ ভূমিকা পালন করে",
    ],
    "ta": [
        "இது குறிப்பிடத்தக்கது என்னவென்றால்", "சூழலில்", "விஷயத்தில்", "என அழைக்கப்படுகிறது",
        "முக்கிய பங்கு வகிக்கிறது",
    ],
    "te": [
        "ఇది గమనించదగినది", "సందర్భంలో", "విషయంలో", "అని పిలుస్తారు", "ముఖ్యమైన పాత్ర పోషిస్తుంది",
    ],
    "kn": [
        "ಇದನ್ನು ಗಮನಿಸಬೇಕು", "ಸಂದರ್ಭದಲ್ಲಿ", "ವಿಷಯದಲ್ಲಿ", "ಎಂದು ಕರೆಯಲಾಗುತ್ತದೆ", "ಪ್ರಮುಖ ಪಾತ್ರ ವಹಿಸುತ್ತದೆ",
    ],
    "pa": [
        "ਇਹ ਧਿਆਨ ਦੇਣ ਯੋਗ ਹੈ ਕਿ", "ਦੇ ਸੰਦਰਭ ਵਿੱਚ", "ਦੇ ਮਾਮਲੇ ਵਿੱਚ", "ਵਜੋਂ ਜਾਣਿਆ ਜਾਂਦਾ ਹੈ",
        "ਮਹੱਤਵਪੂਰਨ ਭੂਮਿਕਾ ਨਿਭਾਉਂਦਾ ਹੈ",
    ],
    "hinglish": [
        "yeh dhyan dene yogya hai", "ke sandarbh mein", "ke maamle mein", "ke roop mein jana jata hai",
    ],
}
#: Forms of address by language and level. Fixed values.
HONORIFICS = {
    "hi": {
        "formal": ["आप", "आपको", "आपका", "आपकी", "आपके"],
        "informal": ["तुम", "तुम्हें", "तुम्हारा", "तुम्हारी"],
        "intimate": ["तू", "तुझे", "तेरा", "तेरी"],
    },
    "mr": {
        "formal": ["तुम्ही", "तुम्हाला", "तुमचा", "तुमची"],
        "informal": ["तू", "तुला", "तुझा", "तुझी"],
        "intimate": [],
    },
    "gu": {
        "formal": ["તમે", "તમને", "તમારું", "તમારી"],
        "informal": ["તું", "તને", "તારું"],
        "intimate": [],
    },
    "bn": {
        "formal": ["আপনি", "আপনার", "আপনাকে"],
        "informal": ["তুমি", "তোমার", "তোমাকে"],
        "intimate": ["তুই", "তোর"],
    },
    "ta": {
        "formal": ["நீங்கள்", "உங்கள்", "உங்களுக்கு"],
        "informal": ["நீ", "உன்", "உனக்கு"],
        "intimate": [],
    },
    "te": {
        "formal": ["మీరు", "మీ", "మీకు"],
        "informal": ["నువ్వు", "నీ", "నీకు"],
        "intimate": [],
    },
    "kn": {
        "formal": ["ನೀವು", "ನಿಮ್ಮ", "ನಿಮಗೆ"],
        "informal": ["ನೀನು", "ನಿನ್ನ", "ನಿನಗೆ"],
        "intimate": [],
    },
    "pa": {
        "formal": ["ਤੁਸੀਂ", "ਤੁਹਾਡਾ", "ਤੁਹਾਨੂੰ"],
        "informal": ["ਤੂੰ", "ਤੇਰਾ", "ਤੈਨੂੰ"],
        "intimate": [],
    },
    "hinglish": {
        "formal": ["aap", "aapko", "aapka", "aapki"],
        "informal": ["tum", "tumhe", "tumhara"],
        "intimate": ["tu", "tujhe", "tera"],
    },
}
#: Over-formal words by language. Fixed values.
FORMAL = {
    "hi": [
        "अत्यंत", "तथापि", "किंचित", "यथोचित", "एवं", "तथा", "हेतु", "उपरांत", "परिलक्षित", "प्रयुक्त", "समुचित",
        "तत्पश्चात", "विद्यमान", "आवश्यकतानुसार", "उल्लेखनीय", "प्रतीत", "स्वास्थ्यवर्धक",
    ],
    "mr": [
        "अत्यंत", "तथापि", "एवं", "तथा", "उपरांत", "प्रयुक्त", "समुचित",
    ],
    "gu": [
        "અત્યંત", "તથાપિ", "એવં", "તથા", "ઉપરાંત",
    ],
    "bn": [
        "অত্যন্ত", "তথাপি", "এবং", "তথা", "উপরন্তু", "প্রযুক্ত",
    ],
    "ta": [
        "மிகவும்", "ஆயினும்", "மேலும்", "எனவே",
    ],
    "te": [
        "అత్యంత", "అయినప్పటికీ", "మరియు", "తథా",
    ],
    "kn": [
        "ಅತ್ಯಂತ", "ಆದಾಗ್ಯೂ", "ಮತ್ತು", "ತಥಾ",
    ],
    "pa": [
        "ਅਤਿਅੰਤ", "ਤਥਾਪਿ", "ਏਵੰ", "ਤਥਾ",
    ],
    "hinglish": [
        "atyant", "tathapi", "evam", "tatha", "hetu",
    ],
}
#: Prepositional calques and relative pronouns, of Hindi and counted in all languages. Fixed values.
HINDI_PREPOSITIONS = ["के रूप में", "के द्वारा", "के माध्यम से"]
HINDI_RELATIVES = ["जो", "जिसे", "जिसमें", "जिससे"]

#: First and last code points of scripts.
SCRIPTS = {
    "Devanagari": (0x0900, 0x097F),
    "Bengali": (0x0980, 0x09FF),
    "Gurmukhi": (0x0A00, 0x0A7F),
    "Gujarati": (0x0A80, 0x0AFF),
    "Oriya": (0x0B00, 0x0B7F),
    "Tamil": (0x0B80, 0x0BFF),
    "Telugu": (0x0C00, 0x0C7F),
    "Kannada": (0x0C80, 0x0CFF),
    "Malayalam": (0x0D00, 0x0D7F),
    "Latin": (0x0041, 0x007A),
}
#: First code points of the digit blocks that count as ASCII digits.
DIGIT_BLOCKS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0BE6, 0x0C66, 0x0CE6, 0x0B66)
INDIC_DIGITS = "".join(chr(b + i) for b in DIGIT_BLOCKS for i in range(10))
ASCII_DIGITS = "0123456789" * len(DIGIT_BLOCKS)

#: Words that open a question and say nothing of the topic, and words without search intent at either end. Fixed values.
QUESTION_OPENERS = [
    "what", "why", "how", "when", "where", "which", "who", "can", "is", "are", "does", "do", "should", "will",
    "क्या", "कैसे", "क्यों", "कब", "कहाँ", "कौन", "किस", "શું", "કેવી", "કેમ", "કિ", "কি", "কীভাবে", "কেন",
    "என்ன", "எப்படி", "ஏன்", "ఏమిటి", "ఎలా", "ఎందుకు", "ಏನು", "ಹೇಗೆ", "ಏಕೆ", "ਕੀ", "ਕਿਵੇਂ", "ਕਿਉਂ",
]
TRAILING_NOISE = [
    "क्या", "हैं", "है", "हो", "करें", "चाहिए", "नहीं", "सकता", "सकती", "सकते", "होता", "होती", "करना", "कर", "को", "जिन्हें", "जो", "वाले", "गया", "रहा",
    "आहे", "आहेत", "काय", "છે", "શું", "কি", "হয়", "என்ன", "ஏன்", "ఏమిటి", "ಏನು", "ਕੀ", "ਹੈ", "ਹਨ",
]
LEADING_NOISE = ["the", "a", "an", "your", "you", "top", "best", "common"]
#: Questions that people type, by language. Fixed values.
QUESTION_STEMS = {
    "hi": ["{} के लक्षण", "{} का इलाज", "{} क्यों होता है", "{} में क्या खाएं", "{} कैसे ठीक करें", "{} के घरेलू उपाय"],
    "mr": ["{} ची लक्षणे", "{} वर उपचार", "{} का होतो", "{} मध्ये काय खावे"],
    "gu": ["{} ના લક્ષણો", "{} ની સારવાર", "{} કેમ થાય છે"],
    "bn": ["{} এর লক্ষণ", "{} এর চিকিৎসা", "{} কেন হয়"],
    "ta": ["{} அறிகுறிகள்", "{} சிகிச்சை", "{} ஏன் வருகிறது"],
    "te": ["{} లక్షణాలు", "{} చికిత్స", "{} ఎందుకు వస్తుంది"],
    "kn": ["{} ಲಕ್ಷಣಗಳು", "{} ಚಿಕಿತ್ಸೆ", "{} ಏಕೆ ಬರುತ್ತದೆ"],
    "pa": ["{} ਦੇ ਲੱਛਣ", "{} ਦਾ ਇਲਾਜ", "{} ਕਿਉਂ ਹੁੰਦਾ ਹੈ"],
    "hinglish": ["{} ke lakshan", "{} ka ilaj", "{} kyu hota hai", "{} me kya khaye", "{} ke gharelu upay"],
}
STEM_GLUE = ["के", "का", "की", "में", "ke", "ka", "me"]
#: What completes a topic to the queries that an autocomplete is asked for. Fixed values.
QUERY_PREFIX = {
    "en": ["how to", "how", "why", "what is", "what are", "when", "which", "can", "is", "does", "best", "symptoms of", "treatment for"],
    "hi": ["क्या", "कैसे", "क्यों", "कब", "कौन सा", "के लक्षण", "का इलाज", "के घरेलू उपाय", "में क्या खाएं"],
}
QUERY_SUFFIX = {
    "en": ["", " symptoms", " treatment", " causes", " diet", " home remedies", " in hindi", " for women", " for men", " vs", " side effects"],
    "hi": ["", " लक्षण", " इलाज", " कारण", " परहेज", " घरेलू उपाय"],
}

#: Health topics, advice to see a clinician, and absolute claims, as parts of words. Fixed values.
HEALTH = ["symptom", "treatment", "dosage", "diagnos", "disease", "medicine", "patient", "therapy", "mg ", "doctor"]
ADVICE = ["consult", "doctor", "physician", "medical advice", "supervision"]
OVERCLAIMS = ["cure", "guaranteed", "100%", "permanent cure", "no side effects", "miracle"]
#: Verbs that give a reason to click. Fixed values.
CALLS = ["learn", "find", "discover", "see", "read", "get", "know", "understand", "check"]

#: Web vitals: good up to, poor beyond, unit. Fixed values.
VITALS = {
    "largest-contentful-paint": (2500.0, 4000.0, "ms"),
    "cumulative-layout-shift": (0.1, 0.25, ""),
    "total-blocking-time": (200.0, 600.0, "ms"),
    "first-contentful-paint": (1800.0, 3000.0, "ms"),
    "interaction-to-next-paint": (200.0, 500.0, "ms"),
    "speed-index": (3400.0, 5800.0, "ms"),
}
