"""Default dictionaries and patterns.

Every operator takes these as parameters; nothing in the operators depends on
the particular words below.
"""

from __future__ import annotations

# --- Fixed values: technology keywords, in report order -------------------
TECH_KEYWORDS = (
    "Python", "FastAPI", "Django", "Flask", "JavaScript", "TypeScript", "React", "Next.js",
    "Vue", "Angular", "Node.js", "NestJS", "Go", "Golang", "Java", "Kotlin", "Spring", "C#",
    ".NET", "PHP", "Laravel", "Ruby", "Rails", "Rust", "SQL", "PostgreSQL", "MySQL", "MongoDB",
    "Redis", "AWS", "GCP", "Azure", "Docker", "Kubernetes", "Terraform", "DevOps", "QA",
    "Selenium", "Cypress", "Playwright", "AI", "ML", "LLM",
)
# a generic keyword that gives way to the specific ones
GENERIC_KEYWORD = "SQL"
SPECIFIC_KEYWORDS = ("PostgreSQL", "MySQL")
# keywords too vague to be taken from prose
VAGUE_KEYWORDS = ("AI", "ML", "LLM", "QA", "DevOps")

# --- Fixed values: words that make a sentence count as stack evidence -----
STACK_EVIDENCE_TERMS = (
    "build", "develop", "implement", "maintain", "deploy", "integrate", "use", "using",
    "work with", "working with", "experience with", "experience in", "proficient in",
    "knowledge of", "apis", "services", "admin screens", "работаем с", "используем", "опыт с",
    "опыт работы с", "разработка на", "пишем на", "сервисы", "api",
)

# --- Fixed values: role policy --------------------------------------------
ALLOWED_ROLE_TERMS = (
    "backend", "back-end", "back end", "frontend", "front-end", "front end", "fullstack",
    "full-stack", "full stack", "ios developer", "ios engineer", "android developer",
    "android engineer", "flutter developer", "flutter engineer", "react native developer",
    "react native engineer", "mobile developer", "mobile engineer", "game developer",
    "gameplay developer", "game backend developer", "unity developer", "unreal developer",
    "ui/ux", "ux/ui", "ui designer", "ux designer", "llm", "ai engineer", "ai developer",
    "ai/ml engineer", "ml engineer", "machine learning engineer", "machine learning developer",
    "devsecops", "automation qa", "qa automation", "test automation engineer",
    "software architect", "technical lead", "artificial intelligence engineer",
    "artificial intelligence developer", "developer", "software engineer", "python engineer",
    "python developer", "java engineer", "java developer", "go engineer", "go developer",
    "golang engineer", "golang developer", "node.js engineer", "node.js developer",
    "react engineer", "react developer", "vue engineer", "vue developer", "angular engineer",
    "angular developer", "typescript engineer", "typescript developer", "javascript engineer",
    "javascript developer", "разработчик", "программист", "backend-разработчик",
    "frontend-разработчик", "фронтенд", "бэкенд", "машинное обучение", "ml-инженер",
    "ai-инженер",
)
DENIED_ROLE_TERMS = (
    "embedded", "firmware", "iot", "robotics", "course", "bootcamp", "cleaner", "janitor",
    "office manager", "sales", "marketing", "support", "driver", "courier", "recruiter",
    "hr manager", "account manager", "customer success", "devops", "sre",
    "site reliability engineer", "cloud engineer", "platform engineer",
    "infrastructure engineer", "database administrator", "dba", "sql administrator",
    "network engineer", "sysadmin", "system administrator", "linux administrator",
    "unix administrator", "manual qa", "manual tester", "sdet",
    "software development engineer in test", "appsec", "application security",
    "security engineer", "security analyst", "solution architect", "engineering manager",
    "technical pm", "technical product manager", "technical project manager",
    "product manager", "project manager", "business analyst", "product owner",
    "scrum master", "product designer", "graphic designer", "web designer",
    "technical writer", "implementation engineer", "solutions consultant",
    "solution consultant", "technical support", "курс", "обучение", "уборщик", "уборщица",
    "офис-менеджер", "офис менеджер", "продажи", "маркетинг", "поддержка", "водитель",
    "курьер", "рекрутер", "системный администратор", "сисадмин", "сетевой инженер",
    "ручное тестирование", "ручной тестировщик", "технический писатель",
    "техническая поддержка", "бизнес аналитик", "продуктовый менеджер",
    "проектный менеджер", "менеджер продукта", "менеджер проекта",
)
BROAD_IT_TERMS = (
    "developer", "engineer", "software", "backend", "frontend", "full stack", "devops",
    "data scientist", "machine learning", "python", "javascript", "typescript", "react",
    "разработчик", "инженер", "программист",
)
MIN_INTAKE_CHARS = 24

# --- Fixed values: message labels -----------------------------------------
FIELD_LABELS = {
    "location": ("location", "локация", "локации", "место", "формат"),
    "stack": ("stack", "стек", "технологии", "skills", "tech stack"),
    "salary": ("salary", "зарплата", "вилка", "compensation", "rate"),
    "company": ("company", "компания"),
    "description": ("description", "описание", "about", "details"),
}
MAX_FIELD_CHARS = 500

# --- Fixed values: patterns of the message parser (Java syntax) -----------
URL_PATTERN = r"""(?iU)https?://[^\s\x1c-\x1f<>)"']+"""
LABEL_LINE_PATTERN = (
    r"(?U)^[\s\x1c-\x1f]*(?:[^\w$€£₽]+)?([\w ]{2,24})[\s\x1c-\x1f]*[:：]"
    r"[\s\x1c-\x1f]*(.+)$"
)
INLINE_STACK_PATTERN = r"(?iU)(?:^|[.\n]\s*)(?:stack|tech stack|skills)\s*[:：]\s*([^.\n]+)"
ROLE_NOUNS = (
    "developer", "engineer", "devops", "qa", "designer", "analyst", "architect",
    "разработчик", "инженер", "тестировщик",
)
TITLE_PATTERN = (
    r"(?iU)((?:senior|middle|junior|lead|staff|principal)?\s*[\w+#./ -]{0,40}"
    r"(?:developer|engineer|devops|qa|designer|analyst|architect|разработчик|инженер|тестировщик)"
    r"[\w+#./ -]{0,50})"
)
LOCATION_LINE_MARKERS = ("локац", "location")
LOCATION_PREFIX_PATTERN = r"(?iU)^\s*(?:📍)?\s*(?:локация|location)\s*:?\s*"
LOCATION_PATTERN = (
    r"(?iU)(remote|удаленн?о|удалённ?о|hybrid|onsite|relocation|europe|usa|us|uk|germany|poland"
    r"|cyprus|serbia|armenia|georgia|казахстан|европа|сша)"
)
REMOTE_WORDS = ("remote", "удаленно", "удалённо")
REMOTE_LABEL = "Удаленно"
SALARY_PATTERN = (
    r"(?iU)((?:\$|€|£)\s?\d[\d\s,.]*(?:\s?-\s?(?:\$|€|£)?\s?\d[\d\s,.]*)?"
    r"|\d[\d\s,.]*\s?(?:usd|eur|gbp|rub|₽|k|тыс\.?)"
    r"(?:\s?-\s?\d[\d\s,.]*\s?(?:usd|eur|gbp|rub|₽|k|тыс\.?))?)"
)
DEFAULT_TITLE = "IT Vacancy"

# --- Fixed values: search-result cleanup and role titles ------------------
TITLE_SUFFIXES = (" | LinkedIn", " в LinkedIn", " on LinkedIn", " - LinkedIn")
HASHTAG_PATTERN = r"(?U)(?<!\w)#[\w.+-]+"
ROLE_TITLE_PATTERNS = (
    r"(?iU)\b((?:(?:junior|middle|mid-level|mid|senior|lead|staff|principal|trainee|intern)\s+)?"
    r"(?:front[-\s]?end|frontend|back[-\s]?end|backend|full[-\s]?stack|full\s+stack|software|cloud|"
    r"python|java|golang|go|node(?:\.js)?|react|vue|angular|typescript|javascript|mobile|ios|android|"
    r"ml|ai|llm|machine\s+learning|data)\s+(?:developer|engineer|architect|programmer)"
    r"(?:\s*\([^)]+\))?)\b",
    r"(?iU)\b((?:(?:junior|middle|mid-level|mid|senior|lead|staff|principal|trainee|intern)\s+)?"
    r"(?:developer|engineer|architect|programmer)\s+"
    r"(?:front[-\s]?end|frontend|back[-\s]?end|backend|full[-\s]?stack|full\s+stack|software|cloud|"
    r"python|java|golang|go|node(?:\.js)?|react|vue|angular|typescript|javascript|mobile|ios|android|"
    r"ml|ai|llm|machine\s+learning|data)(?:\s*\([^)]+\))?)\b",
    r"(?iU)((?:(?:junior|middle|senior|lead|джуниор|мидл|сеньор|ведущий|стаж[её]р)\s+)?"
    r"(?:(?:front[-\s]?end|frontend|back[-\s]?end|backend|full[-\s]?stack|python|java|go|react|"
    r"vue|angular|typescript|javascript|ml|ai|llm)\s*[- ]*)?(?:разработчик|инженер|программист)"
    r"(?:\s+(?:front[-\s]?end|frontend|back[-\s]?end|backend|full[-\s]?stack|python|java|go|react|"
    r"vue|angular|typescript|javascript|ml|ai|llm))?(?:\s*\([^)]+\))?)",
)
LEADING_TAG = "LinkedIn post"
TAG_MARKERS = (
    ("LinkedIn post", "linkedin"),
    ("frontend", "frontend"),
    ("frontend", "front-end"),
    ("backend", "backend"),
    ("fullstack", "fullstack"),
    ("fullstack", "full-stack"),
    ("designer", "designer"),
    ("AI", "ai engineer"),
    ("ML", "ml engineer"),
    ("LLM", "llm"),
    ("Angular", "angular"),
    ("React", "react"),
    ("TypeScript", "typescript"),
    ("JavaScript", "javascript"),
    ("Python", "python"),
    ("REST API", "rest api"),
)
EMPTY_SCALARS = ("nan", "none", "nat")

# --- Fixed values: sites, URL shapes, page markers ------------------------
POST_SITE = "linkedin.com"
POST_PATH_PREFIXES = ("/posts/", "/feed/update/")
POST_URL_MARKERS = ("linkedin.com/posts/", "linkedin.com/feed/update/")
# (substring of the host, reported source), first match wins
SOURCE_HOSTS = (("linkedin.com", "LinkedIn"), ("t.me", "Telegram"), ("telegram.me", "Telegram"))
MESSAGE_SOURCE = "Telegram"
UNKNOWN_SOURCE = "External"
ORIGIN_PREFIX = "https://t.me/"
ACTIVITY_ID_PATTERN = r"(?i)activity-([0-9]{15,20})(?:[-/?#]|$)"
MAIN_TEXT_SELECTORS = (
    "article p.attributed-text-segment-list__content",
    "article [class*='attributed-text-segment-list__content']",
    "p.attributed-text-segment-list__content",
    "[class*='attributed-text-segment-list__content']",
    ".feed-shared-update-v2__description-wrapper",
    ".feed-shared-inline-show-more-text",
    "[data-test-id*='commentary']",
)
MAX_PAGE_TEXT_CHARS = 4000
CHALLENGE_MARKERS = ("challenge-form", "anomaly-modal", "anomaly.js", "captcha", "unusual traffic")
PROTECTION_MARKERS = (
    "captcha to continue", "complete the captcha", "verify you are human", "unusual traffic",
    "security check", "two-factor", "2fa",
)
PAGE_GUARD_MARKERS = ("captcha", "recaptcha", "hcaptcha", "two-factor", "2fa")
PAGE_GUARD_REASONS = ("Site protection detected.", "Login is required.")
SUCCESS_MARKERS = (
    "application submitted", "application has been sent", "thank you for applying",
    "thank you for your application", "vielen dank für deine bewerbung",
    "vielen dank für ihre bewerbung",
)

# --- Fixed values: cards and localization ---------------------------------
MAX_CARD_TAGS = 18
MAX_CARD_DESCRIPTION_CHARS = 1400
MAX_LOCALIZED_CHARS = 700
CYRILLIC = r"Ѐ-ӿ"
LATIN = "A-Za-z"
MIN_SCRIPT_RATIO = 0.35
MAX_ORIGINAL_SIMILARITY = 0.82
LOCALIZATION_REASONS = (
    "returned an empty localized description.",
    "returned text that is not Russian.",
    "returned the original description instead of a Russian translation.",
)

# --- Fixed values: applications -------------------------------------------
APPLICATION_STATUSES = (
    "created", "queued", "loading", "submitting", "parsed", "profile_missing",
    "unsupported_site", "filled", "manual_required", "awaiting_confirmation", "submitted",
    "failed", "cancelled",
)
RETRYABLE_STATUSES = ("created", "queued", "loading", "profile_missing")
NO_URL_ERROR = "Vacancy does not contain an external application URL."
INTERRUPTED_ERROR = (
    "A previous runner stopped during submission. Automatic retry is disabled to prevent a duplicate."
)
NO_RESUME_ERROR = "Queue resume is not configured."
CRASH_BEFORE_ERROR = "Queued application processing failed before submission."
CRASH_AFTER_ERROR = (
    "The runner stopped after submission started. Automatic retry is disabled to prevent a duplicate."
)
RESUME_EXTENSIONS = ("pdf", "docx")
ERROR_REASONS = (
    ("vacancy does not contain an external application url", "у вакансии нет внешней ссылки на форму отклика."),
    ("domain is not in application_allowed_domains", "домен формы не включён в список разрешённых для автоотклика."),
    ("no application adapter is registered for this site", "для этого сайта ещё нет поддерживаемого автозаполнения."),
    (
        "success state could not be verified",
        "бот заполнил форму, но не смог надёжно подтвердить успешную отправку; "
        "повторять автоматически небезопасно.",
    ),
    ("site protection detected", "на странице обнаружена защита вроде CAPTCHA или 2FA."),
    ("login is required", "форма требует входа в аккаунт."),
    (
        "previous runner stopped during submission",
        "предыдущий запуск остановился во время отправки; автоматический повтор отключён, чтобы не отправить дубль.",
    ),
    (
        "runner stopped after submission started",
        "запуск остановился после начала отправки; автоматический повтор отключён, чтобы не отправить дубль.",
    ),
    (
        "queued application processing failed before submission",
        "очередь остановилась до начала отправки, поэтому можно попробовать ещё раз.",
    ),
    ("browser preparation failed", "браузерный запуск не смог подготовить форму."),
    ("browser inspection failed", "браузерный запуск не смог проверить страницу."),
)
DEFAULT_ERROR_REASON = "бот остановил автоматическую отправку из-за неподдержанного состояния формы."
MAX_EXTRA_NAME_CHARS = 64
MAX_EXTRA_VALUE_CHARS = 256
MAX_EXTRA_FIELDS = 20
SKIP_TEXT = "Пропустить"
PROFILE_GAPS = ("имя и фамилия", "email", "резюме в PDF или DOCX")

# --- Fixed values: discovery ----------------------------------------------
CYCLE_SECONDS = 900
INTENTS_PER_CYCLE = 6
# (family, language, query) of the built-in search profile, in order
SEARCH_INTENTS = (
    (
        "backend-software", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Backend Developer" OR '
            '"Backend Engineer" OR "Software Developer" OR "Software Engineer")'
        ),
    ),
    (
        "backend-software", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("бэкенд-разработчик" OR "backend-разработчик" OR '
            '"разработчик ПО" OR "программный инженер")'
        ),
    ),
    (
        "frontend", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Frontend Developer" OR '
            '"Front-End Developer" OR "Frontend Engineer" OR "Front-End Engineer")'
        ),
    ),
    (
        "frontend", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("фронтенд-разработчик" OR "frontend-разработчик" OR '
            '"фронтенд-инженер")'
        ),
    ),
    (
        "fullstack", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Fullstack Developer" OR '
            '"Full-Stack Developer" OR "Fullstack Engineer" OR "Full-Stack Engineer")'
        ),
    ),
    (
        "fullstack", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("фулстек-разработчик" OR "fullstack-разработчик" OR '
            '"фулстек-инженер")'
        ),
    ),
    (
        "mobile", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Mobile Developer" OR '
            '"Mobile Engineer" OR "iOS Developer" OR "Android Developer" OR "Flutter Developer" OR "React '
            'Native Developer")'
        ),
    ),
    (
        "mobile", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("мобильный разработчик" OR "iOS-разработчик" OR '
            '"Android-разработчик" OR "Flutter-разработчик")'
        ),
    ),
    (
        "ml-ai-llm", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Machine Learning '
            'Engineer" OR "ML Engineer" OR "AI Engineer" OR "AI Developer" OR "LLM Engineer")'
        ),
    ),
    (
        "ml-ai-llm", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("инженер машинного обучения" OR "ML-инженер" OR '
            '"AI-инженер" OR "AI-разработчик" OR "LLM-инженер")'
        ),
    ),
    (
        "gamedev", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Game Developer" OR "Game '
            'Engineer" OR "Gameplay Developer" OR "Gameplay Programmer")'
        ),
    ),
    (
        "gamedev", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("разработчик игр" OR "игровой разработчик" OR '
            '"геймплей-программист")'
        ),
    ),
    (
        "automation-qa", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("QA Automation Engineer" '
            'OR "Automation QA Engineer" OR "Test Automation Engineer")'
        ),
    ),
    (
        "automation-qa", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("инженер по автоматизации тестирования" OR "QA automation '
            'инженер" OR "автоматизатор тестирования")'
        ),
    ),
    (
        "devsecops", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("DevSecOps Engineer" OR '
            '"DevSecOps Developer")'
        ),
    ),
    (
        "devsecops", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("DevSecOps-инженер" OR "инженер DevSecOps")'
        ),
    ),
    (
        "blockchain", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Blockchain Developer" OR '
            '"Blockchain Engineer" OR "Smart Contract Developer")'
        ),
    ),
    (
        "blockchain", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("блокчейн-разработчик" OR "блокчейн-инженер" OR '
            '"разработчик смарт-контрактов")'
        ),
    ),
    (
        "enterprise-developer", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Enterprise Developer" OR '
            '"Java Developer" OR "Python Developer" OR "Go Developer" OR "Node.js Developer" OR "Software '
            'Programmer")'
        ),
    ),
    (
        "enterprise-developer", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("корпоративный разработчик" OR "Java-разработчик" OR '
            '"Python-разработчик" OR "Go-разработчик" OR "программист")'
        ),
    ),
    (
        "software-architecture-lead", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("Software Architect" OR '
            '"Technical Lead" OR "Tech Lead")'
        ),
    ),
    (
        "software-architecture-lead", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("архитектор ПО" OR "программный архитектор" OR "технический '
            'лидер" OR "техлид")'
        ),
    ),
    (
        "ui-ux", "en",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("we are hiring" OR "we\'re hiring" '
            'OR "hiring for" OR "looking for" OR "join our team" OR "open role") ("UI/UX Designer" OR "UX/UI '
            'Designer" OR "UI Designer" OR "UX Designer")'
        ),
    ),
    (
        "ui-ux", "ru",
        (
            '(site:linkedin.com/posts OR site:linkedin.com/feed/update) ("ищем" OR "ищет" OR "нанимаем" OR '
            '"в команду" OR "открыта вакансия") ("UI/UX-дизайнер" OR "UX/UI-дизайнер" OR "дизайнер '
            'интерфейсов" OR "UX-дизайнер")'
        ),
    ),
)


def default_intents() -> list[tuple[int, str, str, str]]:
    """(intent_pos, family, language, query) of the built-in search profile, 1-based."""
    return [(place, *row) for place, row in enumerate(SEARCH_INTENTS, start=1)]
