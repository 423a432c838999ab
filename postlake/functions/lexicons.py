"""Fixed values that results depend on: word lists, keys, patterns, limits.

Every operator takes its list as an argument; these are the defaults.
"""

# --- URLs -------------------------------------------------------------------
API_URL_TOKENS = ("api", "graphql", "job", "career", "position", "opening", "greenhouse", "workday")
PAGING_PARAMS = ("limit", "offset", "page", "sortby", "sortorder")
URL_ID_PATTERNS = (
    r"(?i)/(\d{6,})$",
    r"(?i)/(\d{6,})/",
    r"(?i)req[_\-]?id\s*[:=]?\s*([A-Za-z0-9\-]+)",
)
BOARD_URL_PATTERN = r"(?i)https?://(?:boards|job-boards)\.greenhouse\.io/([a-zA-Z0-9_-]+)"
BOARD_PARAM_PATTERN = r"(?i)[?&]for=([a-zA-Z0-9_-]+)"
BOARD_HOST = "greenhouse.io"
WORKDAY_ENDPOINT_PATTERN = r"""(?i)(?:https?:)?//[^"'\s]+/wday/cxs/[^"'\s]+"""
COMPANY_TOKEN_PATTERN = r'(?i)"company"\s*:\s*"([^"]+)"|"tenant"\s*:\s*"([^"]+)"'
COMMON_JOB_PATHS = (
    "/jobs",
    "/jobs.json",
    "/careers/jobs",
    "/careers/jobs.json",
    "/api/jobs",
    "/api/jobs.json",
    "/api/careers/jobs",
)
ENDPOINT_KEYWORDS = ("job", "jobs", "career", "position", "opening", "search", "listing")

# --- Page signals -----------------------------------------------------------
ANCHOR_PATTERN = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
TAG_PATTERN = r"<[^>]+>"
HREF_PATTERN = r"""(?i)href=["']([^"']+)["']"""
PAGE_TERMS = (
    "job", "jobs", "career", "careers", "opening", "openings", "position", "positions", "apply",
)
PAGING_TERMS = ("load more", "show more", "next page", "next jobs", "pagination", "page 2")
LINK_HREF_TOKENS = ("job", "career", "position", "opening", "requisition")
LINK_LABEL_TOKENS = ("apply", "job", "position", "opening", "career")
DISCOVERED_TOKENS = ("job", "career", "position", "opening", "search")
INTERACTIVE_TERMS = (
    "job", "position", "location", "apply", "responsibilities", "requirements", "qualifications",
    "experience", "department", "career", "opening", "openings", "role", "team",
)
INTERACTIVE_LINK_PATTERNS = (
    r"/job[sS]?", r"/position[sS]?", r"/career[sS]?", r"/opening[sS]?", r"/apply", r"job_id",
    r"requisition", r"/careers/.*-\w+",
)

# --- Listing filters --------------------------------------------------------
LISTING_BAD_TITLES = (
    "privacy", "legal", "cookie", "terms", "accessibility", "benefits", "culture", "diversity",
    "students", "internship", "saved jobs", "talent community", "job alert", "sign in", "log in",
    "register", "profile", "settings",
)
LISTING_BAD_URLS = (
    "/privacy", "/legal", "/cookie", "/terms", "/accessibility", "/benefits", "/culture",
    "/diversity", "/student", "/intern", "/saved-jobs", "/profile", "/login", "/register",
    "/settings", "/about", "/contact", "/help", "/faq",
)
LISTING_SIGNALS = ("job", "career", "position", "opening", "role", "apply")
LISTING_GENERIC_LABELS = ("apply now", "view details", "learn more", "read more", "click here")
CARD_NAV_TITLES = ("search", "apply", "menu", "next", "previous")
CARD_GENERIC_TITLES = (
    "english", "careers", "career", "saved jobs", "saved jobs 0", "my applications",
    "search jobs", "open positions", "subscribe for job alerts", "join our talent community",
    "why concentrix", "perks & benefits", "sustainability", "recruitment fraud alert", "legal",
    "privacy policy", "gdpr", "personal information", "google's eeo policy", "eeo (english)",
    "eeo (spanish)", "how we hire", "learn more about our culture",
    "learn more about our benefits", "explore remote jobs", "apply now", "view details",
    "step 1: application", "step 2: digital self assessment",
    "step 3: process specific assessments", "step 4: interview", "step 5: offer letter",
)
CARD_GENERIC_PARTS = (
    "talent community", "job alerts", "saved jobs", "privacy", "legal", "cookie", "application",
    "interview", "offer letter", "fraud",
)
CARD_BAD_URLS = (
    "/saved-jobs", "/job-cart", "/profile/", "/login", "/privacy", "/legal", "/cookies",
    "/job-alert", "/join-community", "/apply-form/", "/accessibility", "/benefits", "/culture",
    "/how-we-hire", "/eeo", ".pdf",
)
CARD_LINK_TOKENS = ("job", "career", "position", "opening", "requisition", "vacancy")
CARD_JOB_URLS = (
    "/job/", "/job-detail/", "/jobs/detail", "/position/", "/opening/", "/requisition/",
)
CARD_PLACE_WORDS = ("remote", "india", "united", "hyderabad", "bangalore")
CARD_ACTION_LABELS = ("apply now", "view details")
CARD_SKIPPED_LINES = ("apply now", "view details", "saved jobs", "talent community")
CARD_PLACE_BLOCKERS = ("apply", "save job", "share")

# --- Section removal --------------------------------------------------------
DROPPED_SECTIONS = (
    "about us", "who we are", "our company", "company description", "equal employment", "eeo",
    "equal opportunity", "diversity", "inclusion", "privacy", "cookie", "terms of use",
    "terms and conditions", "disclaimer", "legal notice", "accessibility", "contact us",
    "careers page", "back to top", "share this job", "job alerts", "apply now",
)
SECTION_TAGS = ("div", "section", "article", "aside", "p", "ul", "ol")

# --- Field selectors and patterns -------------------------------------------
COMPANY_SELECTORS = (
    "[data-testid=company-name]", ".company-name", ".company",
    "[itemprop=hiringOrganization]", "[itemprop=name]",
)
LOCATION_SELECTORS = (
    "[data-testid=location]", ".location", "[itemprop=jobLocation]", ".job-location",
)
DESCRIPTION_SELECTORS = (
    "[itemprop=description]", ".job-description", "#job-description", ".description",
    ".job-details",
)
COMPANY_PATTERNS = (
    r"(?U)at\s+([A-Z][A-Za-z\s&]+?)(?:\n|$)",
    r"(?U)([A-Z][A-Za-z\s&]+?)\sis\s+(?:hiring|looking|seeking)",
)
COMPANY_HINT = r"(?U)\sis\s+(?:hiring|looking|seeking)"
LOCATION_PATTERNS = (
    r"(?U)(?:Location|City|Place|Where)\s*[:\-]\s*([^\n]{2,80})",
    # A match can only start where a run of letters starts; saying so keeps the search linear.
    r"(?U)((?<![A-Za-z\s])[A-Za-z\s]++,\s*[A-Za-z\s]{2,40})",
)
DESCRIPTION_PATTERN = (
    r"(?iU)(?:about\s+the\s+role|job\s+summary|overview|description)\s*[:\-]?\s*"
    r"([\s\S]{100,%d})(?=\n\s*\n\s*[A-Z])"
)
SALARY_PATTERNS = (
    r"(?i)(?:salary|compensation|pay|ctc|package)\s*[:\-]?\s*([^\n]{5,100})",
    r"(?i)(\$|₹|EUR|USD|INR)\s*[\d,\s\-]+(?:per\s+year|per\s+month|annum|annually)?",
)
SALARY_PATTERNS_OLD = (
    SALARY_PATTERNS[0],
    r"(?i)(\$|₹|EUR|USD|INR)[\d,\s\-]+(?:per\s+year|per\s+month|annum|annually)?",
)
EXPERIENCE_PATTERNS = (
    r"(?i)(?:experience|years?|yrs?)\s*[:\-]?\s*([\d+\-]+\s*(?:to?\s*)?[\d+]*\s*(?:years?)?)",
    r"(?i)(\d+\+?)\s*\+?\s*(?:years?|yrs?)",
    r"(?i)(\d+\s*[-–to]+\s*\d+)\s*(?:years?|yrs?)",
)
EMPLOYMENT_TERMS = (
    r"remote", r"full\s*time", r"part\s*time", r"contract", r"temporary", r"hybrid", r"on\s*site",
)
POSTED_PATTERNS = (
    r"(?i)(?:posted|posted\s+on|date)\s*[:\-]?\s*([\d/\-\.]+\s*[A-Za-z]*)",
    r"(?i)(\d{1,2}[/\-\.\s]\d{1,2}[/\-\.\s]\d{2,4})",
    r"(?i)(\d{4}[/\-\.\s]\d{1,2}[/\-\.\s]\d{1,2})",
)
REMOTE_PATTERN = r"(?i)(remote|work\s+from\s+home|wfh|hybrid|on-site|onsite|in-office)"
SKILL_TERMS = (
    "Python", "Java", "JavaScript", "TypeScript", "Go", "Golang", "Rust", "C++", "C#", "React",
    "Angular", "Vue", "Node.js", "Django", "Flask", "Spring", "FastAPI", "SQL", "NoSQL",
    "PostgreSQL", "MongoDB", "Redis", "MySQL", "AWS", "Azure", "GCP", "Docker", "Kubernetes",
    "Terraform", "Ansible", "Machine Learning", "Deep Learning", "NLP", "Computer Vision",
    "Agile", "Scrum", "CI/CD", "DevOps", "Microservices", "REST API", "GraphQL", "gRPC",
    "Kafka", "RabbitMQ", "Git", "Linux", "Bash", "Shell Scripting",
)

# --- Raw API objects --------------------------------------------------------
RAW_KEYS = {
    "title": ("title", "job_title", "name"),
    "location": ("location", "locationsText", "city", "country"),
    "job_id": ("externalPath", "id", "reqId", "requisition_id", "job_id"),
    "company_name": ("company", "company_name", "organization"),
    "department": ("department", "job_family", "category", "team"),
    "employment_type": ("employment_type", "employmentType", "job_type", "workType"),
    "posted_on": ("posted_date", "posted_on", "created_at", "date_posted", "publish_date"),
    "salary": ("salary", "compensation", "pay_rate", "salary_text"),
    "remote_type": ("remote_type", "remote", "workplaceType", "workplace_type", "work_model"),
    "description": (
        "description", "job_description", "jobDescription", "content", "summary", "detail",
        "overview",
    ),
    "experience": (
        "experience", "years_of_experience", "min_experience", "required_experience",
        "experience_level",
    ),
    "education": (
        "education", "degree", "education_required", "educational_requirements",
        "minimum_education",
    ),
}
RAW_PLACE_PARTS = (
    "city", "state", "country", "addressLocality", "addressRegion", "addressCountry",
)
RAW_SKILL_KEYS = (
    "skills", "required_skills", "skill_set", "technologies", "tools", "tech_stack",
    "competencies", "key_skills",
)
RAW_BULLET_KEYS = ("skills", "qualifications", "requirements")
RAW_QUALIFICATION_KEYS = (
    "qualifications", "requirements", "required_qualifications", "minimum_qualifications",
    "preferred_qualifications",
)
RAW_KNOWN_KEYS = (
    "title", "location", "url", "description", "skills", "experience", "education",
    "qualifications", "employment_type", "salary", "posted_on", "company", "company_name",
    "department", "remote_type", "externalPath", "id", "reqId", "requisition_id", "job_id",
    "bulletFields", "subNavLinks",
)
JOB_LIST_KEYS = (
    "jobs", "results", "data", "positions", "openings", "items", "records", "jobPostings",
    "job_postings", "job_list", "jobs_list", "jobOpenings", "opportunities", "careers",
)
ENTRY_TITLE_KEYS = ("title", "job_title", "name", "position", "jobTitle", "postingTitle")
ENTRY_PLACE_KEYS = (
    "location", "locationsText", "city", "country", "addressLocality", "addressRegion",
    "locationText", "geo", "workLocation",
)
ENTRY_PLACE_PARTS = (
    ("city", "addressLocality"), ("state", "addressRegion"), ("country", "addressCountry"),
)
ENTRY_URL_KEYS = (
    "url", "job_url", "link", "href", "apply_url", "applyUrl", "detailUrl", "jobUrl",
)
ENTRY_ID_KEYS = (
    "id", "job_id", "externalPath", "reqId", "requisition_id", "jobId", "postingId",
)
ENTRY_EXTRAS = ("department", "employment_type", "posted_date", "salary", "remote_type")
SIMPLE_LIST_KEYS = ("jobs", "positions", "results", "openings")
SIMPLE_TITLE_KEYS = ("title", "job_title")
SIMPLE_PLACE_KEYS = ("location", "city", "country")
SIMPLE_URL_KEYS = ("url", "link", "absolute_url", "apply_url", "jobUrl", "details_url")
PLACE_NAME_KEYS = ("name", "city", "label", "location", "country")
COUNT_LIST_KEYS = ("jobs", "results", "data", "positions", "openings", "items", "records")
COUNT_TOTAL_KEYS = ("total", "count", "total_results", "num_jobs", "job_count")
PAGING_OBJECT_KEYS = (
    "total", "count", "totalResults", "total_jobs", "hasMore", "nextPage", "pageInfo",
)

# --- Response scoring -------------------------------------------------------
RESPONSE_TERMS = (
    "job", "title", "location", "description", "position", "career", "department", "team",
    "posting", "requisition", "vacancy",
)
RESPONSE_PAGING_TERMS = ("page", "limit", "offset", "cursor", "next", "total")
ENDPOINT_TERMS = ("title", "job", "position", "location", "apply", "career")
ENDPOINT_UI_TERMS = ("menu", "submenu", "layout", "navigation", "nav", "header", "footer")
ENDPOINT_PAGING_TERMS = ("offset", "page", "cursor", "limit", "pages", "pagesize", "totalpages")

# --- Strategy ---------------------------------------------------------------
SITE_TYPES = (
    "WORKDAY_API", "GREENHOUSE_API", "DYNAMIC_API", "SIMPLE_API", "INTERACTIVE_DOM",
    "DOM_LOAD_MORE", "DOM_INFINITE_SCROLL", "DOM_BROWSER",
)
UNKNOWN = "UNKNOWN"

# --- Chunk ranking ----------------------------------------------------------
RELEVANT_TERMS = (
    "responsibilities", "requirements", "qualifications", "skills", "experience",
    "what you will do", "what you'll do", "what we are looking for", "what we're looking for",
    "job summary", "job description", "about the role", "position summary", "role description",
    "duties", "key responsibilities", "main responsibilities", "essential duties",
    "required qualifications", "minimum qualifications", "preferred qualifications",
    "required skills", "preferred skills", "technical skills", "professional experience",
    "work experience", "years of experience", "education", "certifications", "competencies",
    "capabilities",
)
IRRELEVANT_TERMS = (
    "about us", "who we are", "our company", "company description", "equal employment", "eeo",
    "eeo policy", "equal opportunity", "diversity", "inclusion", "benefits", "perks",
    "compensation and benefits", "why work with us", "why join us", "privacy", "cookie",
    "terms of use", "contact us", "careers page", "back to top", "apply now", "share this job",
    "job alerts", "disclaimer", "legal notice", "accessibility",
)
SUMMARY_HEADINGS = (
    "job summary", "job description", "about the role", "position summary", "role overview",
    "summary", "description",
)

# --- Records ----------------------------------------------------------------
REPLY_PRIORITY_FIELDS = (
    "skills", "required_skills", "preferred_skills", "soft_skills", "inferred_skills",
    "experience", "qualifications", "education", "certifications", "tools_and_technologies",
    "additional_sections", "salary", "posted_on", "employment_type", "remote_type", "job_id",
)
LIST_FIELDS = (
    "required_skills", "preferred_skills", "soft_skills", "inferred_skills", "skills",
    "tools_and_technologies", "qualifications", "certifications", "benefits",
    "key_responsibilities",
)
STRING_FIELDS = (
    "title", "company_name", "employment_type", "posted_on", "job_description", "description",
    "about_company",
)
DETAIL_FIELDS = (
    "title", "description", "experience", "education", "salary", "posted_on", "employment_type",
    "company_name", "remote_type", "qualifications", "skills", "required_skills",
    "additional_sections",
)
COMPANY_COLUMN_WORDS = ("company", "name", "organization", "employer")
URL_COLUMN_WORDS = (
    ("india_career_page",), ("career_page", "career", "url", "link"), ("page", "website"),
)
