"""Word lists of the question rules. Every operator takes its list as an argument; these are the defaults."""

# They must be these for the same answers, in this order.
NOT_FOUND = "I'm sorry, I don't have enough information to answer that based on the available college resources."

EXPANSIONS = [
    ("pg", "post graduate courses and programmes"),
    ("postgraduate", "post graduate courses and programmes"),
    ("post graduate", "post graduate courses and programmes"),
    ("ug", "under graduate courses and programmes"),
    ("undergraduate", "under graduate courses and programmes"),
    ("under graduate", "under graduate courses and programmes"),
    ("course", "what courses are offered by the college"),
    ("courses", "what courses are offered by the college"),
    ("program", "what academic programs are available"),
    ("programs", "what academic programs are available"),
    ("fee", "what are the fees and tuition charges"),
    ("fees", "what are the fees and tuition charges"),
    ("admission", "what is the admission process and requirements"),
    ("eligibility", "what are the eligibility criteria"),
    ("department", "what departments are available"),
    ("scholarship", "what scholarships are available"),
    ("placement", "what placement support is available"),
    ("hostel", "is hostel accommodation available"),
    ("principal", "who is the principal of the college"),
]

TOPICS = [
    ("pg", "Post Graduate"),
    ("p g", "Post Graduate"),
    ("postgraduate", "Post Graduate"),
    ("post graduate", "Post Graduate"),
    ("ug", "Under Graduate"),
    ("u g", "Under Graduate"),
    ("undergraduate", "Under Graduate"),
    ("under graduate", "Under Graduate"),
]

SMALL_TALK = [
    ("hi", "Hello! How can I help you with college-related information?"),
    ("hello", "Hello! How can I help you with college-related information?"),
    ("hey", "Hello! How can I help you with college-related information?"),
    ("good morning", "Good morning! How can I help you with college-related information?"),
    ("good afternoon", "Good afternoon! How can I help you with college-related information?"),
    ("good evening", "Good evening! How can I help you with college-related information?"),
    ("thank you", "You're welcome!"),
    ("thanks", "You're welcome!"),
    ("thankyou", "You're welcome!"),
    ("ok", "Okay."),
    ("okay", "Okay."),
    ("alright", "Alright."),
    ("bye", "Goodbye! Feel free to ask if you need more college-related information."),
    ("goodbye", "Goodbye! Feel free to ask if you need more college-related information."),
    ("see you", "See you!"),
]

FOLLOW_UPS = [
    "short answer", "provide short answer", "just provide short answer", "make it short", "shorter", "summarize", "summarise", "in short",
    "answer in", "in 2 lines", "in two lines", "in 3 lines", "in three lines", "only bullet", "only bullets", "bullet points", "make it bullet",
    "make it simple", "simple answer", "simplify", "brief", "briefly", "concise",
    "explain more", "tell me more", "more details", "give more details", "elaborate", "explain in detail", "details", "expand", "expand it",
    "that", "this", "it", "above", "previous", "same", "what about",
]

#: (category, pattern), the first that fits decides.
CATEGORIES = [
    ("Courses", "course|program|subject|class|bca|bcom|degree"),
    ("Admissions", "admission|apply|eligib|enroll|application"),
    ("Fees", "fee|tuition|scholarship|payment|cost"),
    ("Hostel", "hostel|accommodation|room|dorm"),
    ("Faculty", "faculty|teacher|professor|principal|hod"),
]

DEFAULT_SUGGESTIONS = ["What courses are available?", "What is the admission process?", "What are the eligibility criteria?"]

#: (parts of the question, whole questions, suggestions), the first that fits decides.
SUGGESTIONS = [
    (["outdoor", "sports"], [], ["What sports or outdoor activities are available?", "What student activities are available?", "What facilities are available for students?"]),
    (["activity", "activities"], [], ["What student activities are available?", "What college activities are mentioned?", "What social service activities are available?"]),
    (["fee"], [], ["What are the tuition fees?", "What fees are mentioned in the college resources?", "What payment or admission fee details are available?"]),
    (["admission", "apply"], [], ["What is the admission process?", "What admission requirements are there?", "What are the eligibility criteria?"]),
    (["course", "program"], ["pg", "ug"], ["What courses are available?", "What academic programs are available?", "What are the eligibility criteria?"]),
]

EXTENSIONS = [".pdf", ".docx", ".txt", ".html", ".htm", ".csv", ".md", ".markdown", ".json", ".xlsx", ".xls", ".sql", ".dump", ".png", ".jpg", ".jpeg", ".webp"]

#: Between the messages of an exported conversation.
RULE = "----------------------"

#: How an assistant's message begins that stands for a failed request.
ERRORS = ["\u26a0"]

#: Cells of a table file that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: Kinds of files whose name isn't their extension's.
FILE_TYPES = [("markdown", [".md", ".markdown"]), ("db_dump", [".sql", ".dump"]), ("html", [".html", ".htm"]), ("xlsx", [".xlsx", ".xls"]), ("image_ocr", [".png", ".jpg", ".jpeg", ".webp"])]

#: Fixed values too: (label, extensions); anything else is DOC.
TYPE_LABELS = [("PDF", ["pdf"]), ("DOC", ["doc", "docx"]), ("WEB", ["html", "htm"]), ("TXT", ["txt", "md"]), ("DATA", ["csv", "xlsx", "xls"])]
