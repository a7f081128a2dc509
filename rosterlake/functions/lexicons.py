"""Word lists and tables that results depend on.

Fixed values: they must equal the values the results are defined by, and stand here in their natural order.
"""

SKILL_ALIASES = {
    "js": ["javascript", "ecmascript"],
    "javascript": ["js", "ecmascript"],
    "react": ["reactjs", "react.js", "reactjs"],
    "reactjs": ["react", "react.js"],
    "react.js": ["react", "reactjs"],
    "node": ["nodejs", "node.js"],
    "nodejs": ["node", "node.js"],
    "node.js": ["node", "nodejs"],
    "vue": ["vuejs", "vue.js"],
    "vuejs": ["vue", "vue.js"],
    "vue.js": ["vue", "vuejs"],
    "angular": ["angularjs", "angular.js"],
    "angularjs": ["angular", "angular.js"],
    "angular.js": ["angular", "angularjs"],
    "typescript": ["ts"],
    "ts": ["typescript"],
    "html": ["html5"],
    "html5": ["html"],
    "css": ["css3"],
    "css3": ["css"],
    "python": ["py"],
    "py": ["python"],
    "java": ["spring", "spring framework", "spring boot", "hibernate", "j2ee", "jee"],
    "spring": ["java", "spring framework", "spring boot"],
    "spring framework": ["java", "spring", "spring boot"],
    "spring boot": ["java", "spring", "spring framework"],
    "hibernate": ["java"],
    "j2ee": ["java"],
    "jee": ["java"],
    "machine learning": ["ml", "machinelearning"],
    "ml": ["machine learning", "machinelearning"],
    "artificial intelligence": ["ai"],
    "ai": ["artificial intelligence"],
    "aws": ["amazon web services"],
    "amazon web services": ["aws"],
    "gcp": ["google cloud platform", "google cloud"],
    "google cloud platform": ["gcp", "google cloud"],
    "google cloud": ["gcp", "google cloud platform"],
    "azure": ["microsoft azure"],
    "microsoft azure": ["azure"],
    "kubernetes": ["k8s"],
    "k8s": ["kubernetes"],
    "docker": ["docker container"],
    "postgresql": ["postgres", "pg"],
    "postgres": ["postgresql", "pg"],
    "pg": ["postgresql", "postgres"],
    "mongodb": ["mongo"],
    "mongo": ["mongodb"],
    "redis": ["redis cache"],
    "git": ["git version control"],
    "rest": ["rest api", "restful api", "rest apis"],
    "rest api": ["rest", "restful api", "rest apis"],
    "rest apis": ["rest", "rest api", "restful api"],
    "restful api": ["rest", "rest api", "rest apis"],
    "graphql": ["graph ql"],
    "graph ql": ["graphql"],
    "sql": ["mysql", "postgresql", "postgres", "sql server", "mssql", "oracle"],
    "mysql": ["sql"],
    "mssql": ["sql", "sql server"],
    "sql server": ["sql", "mssql"],
    "oracle": ["sql"],
    "scrum": ["scrum/agile", "agile", "scrum agile"],
    "agile": ["scrum", "scrum/agile", "scrum agile"],
    "scrum/agile": ["scrum", "agile"],
    "scrum agile": ["scrum", "agile"],
    "net": [".net", "dotnet", "dot net"],
    ".net": ["net", "dotnet", "dot net"],
    "dotnet": ["net", ".net", "dot net"],
    "dot net": ["net", ".net", "dotnet"],
    "next.js": ["nextjs", "next js"],
    "nextjs": ["next.js", "next js"],
    "next js": ["next.js", "nextjs"],
}
PLURALS = {"apis": "api", "frameworks": "framework", "tools": "tool", "languages": "language"}
NOT_THE_SAME = [("java", "javascript"), ("js", "javascript"), ("net", "internet"), ("go", "golang")]

DIMENSION_WEIGHTS = {"skill": 0.40, "experience": 0.25, "project": 0.20, "domain": 0.15}

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LOOSE_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
PHONES = [r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\+?\d{1,3}[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", r"\d{10}"]
DATE_RANGE = r"\b(?:19|20)\d{2}\s*[-–—]\s*(?:19|20)?\d{2}|PRESENT|CURRENT\b"
VALIDITY_FAMILIES = {
    # family: (points a word, most points, words)
    "job_titles": (2, 10, ["developer", "engineer", "manager", "analyst", "consultant", "architect", "designer", "specialist", "coordinator", "director", "lead", "senior", "junior", "intern", "executive", "officer", "administrator"]),
    "experience": (3, 15, ["experience", "work history", "employment", "career", "position", "role", "responsibilities", "achievements", "projects"]),
    "education": (3, 15, ["education", "degree", "university", "college", "institute", "bachelor", "master", "phd", "diploma", "certification", "graduation"]),
    "skills": (2, 10, ["skills", "technologies", "tools", "programming", "languages", "frameworks", "platforms", "software"]),
    "companies": (1, 5, ["pvt", "ltd", "inc", "llc", "corp", "technologies", "solutions", "services"]),
}
OTHER_DOCUMENTS = ["invoice", "receipt", "bill", "contract", "agreement", "letter", "memo", "report", "proposal", "presentation", "abstract", "references", "bibliography", "methodology", "hypothesis", "experiment", "results and discussion", "terms and conditions", "privacy policy", "terms of service"]
VALID_FROM, SHORTEST_TEXT = 30, 200

SENIORITY_WORDS = {
    "junior": ["junior", "entry", "entry-level", "associate", "intern"],
    "mid": ["mid", "mid-level", "intermediate", "experienced"],
    "senior": ["senior", "sr", "lead", "principal", "staff"],
    "executive": ["executive", "director", "vp", "vice president", "chief"],
}
SENIORITY_TITLES = ["junior", "senior", "mid", "lead", "principal", "staff", "executive", "director"]
JOB_SKILLS = [
    "python", "java", "javascript", "typescript", "go", "rust", "c++", "c#", "ruby", "php", "swift", "kotlin", "scala", "r", "matlab",
    "react", "angular", "vue", "next.js", "node.js", "express", "django", "flask", "fastapi", "spring", "laravel", "rails",
    "sql", "postgresql", "mysql", "mongodb", "redis", "cassandra", "elasticsearch", "dynamodb", "oracle",
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "ansible", "jenkins", "gitlab", "github actions", "ci/cd",
    "machine learning", "deep learning", "ai", "data science", "nlp", "computer vision", "tensorflow", "pytorch", "pandas", "numpy",
    "agile", "scrum", "microservices", "rest api", "graphql", "grpc",
]
YEARS_PATTERNS = [
    r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:experience|exp)",
    r"(?:experience|exp)[:\s]+(\d+)\+?\s*(?:years?|yrs?)",
    r"minimum\s+of\s+(\d+)\s*(?:years?|yrs?)",
    r"at\s+least\s+(\d+)\s*(?:years?|yrs?)",
    r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:professional|software|development|engineering|devops|infrastructure)",
    r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:in|with)",
    r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:relevant|related)",
]
EDUCATION_PATTERNS = {
    "bachelor": r"(?:bachelor|bs|b\.?s\.?|b\.?a\.?)\s+(?:degree|in)",
    "master": r"(?:master|ms|m\.?s\.?|m\.?a\.?|mba)\s+(?:degree|in)",
    "doctorate": r"(?:ph\.?d|doctorate)",
    "school": r"(?:high\s+school|diploma)",
}
LOCATION_PATTERNS = [r"location[:\s]+([^\n]+)", r"based\s+in\s+([^\n,]+)", r"office\s+location[:\s]+([^\n]+)"]
REMOTE = ["remote", "work from home", "wfh", "distributed", "anywhere"]
ON_SITE = ["on-site", "on site", "office", "onsite"]

COMPLETENESS = {"experience": (0.5, 3.0), "education": (0.5, 1.0), "skills": (0.1, 2.0), "projects": (0.3, 1.0)}
EXPLANATIONS = {
    "required": "Has %s out of %s required skills",
    "nice": "Matches %s nice-to-have skills",
    "matched": "Key matched skills: %s",
    "missing": "Missing %s required skills: %s",
    "fewer_years": "Has %s fewer years of experience than required",
    "more_years": "Has %s more years of experience than required",
    "strong": "Strong skill alignment (%s%% match)",
    "limited": "Limited skill overlap (%s%% match)",
    "none": "Candidate shows potential with relevant background",
}
COMPANY_SUFFIXES = ["pvt", "ltd", "inc", "llc", "corp", "corporation", "technologies", "tech", "software", "solutions", "services"]
COMPANY_MARKS = ["technologies", "software", "solutions", "systems", "pvt", "ltd", "llc", "inc", "corp", "company"]
ACTION_VERBS = ["contributed", "developed", "created", "built", "designed", "handled", "managed", "led", "worked", "delivered"]
SKILL_NOISE = [
    r"(?i)^(and|or|the|a|an|with|from|to|using|via|through|for|in|on|at|handling|everything)\s+",
    r"(?i)^(like|including|such as|e\.g\.|for example)\s+",
    r"(?i)\s+(like|including|etc\.?)$",
    r"\([^)]*\)",
    "(?i)" + DATE_RANGE,
]
SKILL_PHRASE = r"(?i)\b(handling|everything|from|to|with|using|via|through|contributed|developed|created|built|delivered)\b"
SKILL_PHRASE_NAMES = ["system design", "rest api", "microservice", "api"]
SKILL_ALTERNATIVES = r"(?is)\s+(?:/|and|or)\s+.*$"
SKILL_STOP_WORDS = ["the", "and", "or", "with", "using", "via", "through", "for", "in", "on", "at", "like", "handling", "everything"]

#: Résumé sections: words that head them, as patterns.
SECTION_HEADS = {
    "skills": "technical skills|skills|technologies",
    "experience": "work experience|professional experience|experience|employment",
    "education": "education|academic|qualifications",
    "projects": "projects|project|portfolio",
    "certifications": "certifications|certification|certificates",
    "languages": "languages|language",
}
ENTRY_RANGE = r"(\d{4}(?:-\d{2})?)\s*[-–—]\s*(\d{4}(?:-\d{2})?|PRESENT|CURRENT|NOW|Present|Current|Now|present|current|now)"
ENTRY_COMPANY = r"^[A-Z][A-Za-z0-9\s&]+(?:Pvt|Ltd|LLC|Inc|Corp|Corporation|Technologies|Solutions|Services|Systems|Group|Company|Co|Progress)\.?$"
ENTRY_TITLE = r"\b(?:(?:Senior|Junior|Lead|Principal|Staff|Associate|Full Stack|Backend|Frontend|DevOps|Data|Cloud|Product|Project|Business|Technical)\s+[A-Z][a-z]+|[A-Z][a-z]+\s+(?:Developer|Engineer|Manager|Designer|Analyst|Specialist|Architect|Consultant|Director))\b"
TITLE_AT_COMPANY = r"^(.+?)(?:\s+at\s+|\s+-\s+|\s+@\s+)([^\d].*)$"
EDUCATION_WORDS = ["UNIVERSITY", "COLLEGE", "INSTITUTE", "SCHOOL", "BACHELOR", "MASTER", "MCA", "BSC", "MSC", "DEGREE", "ACADEMIC", "COURSEWORK"]
WORK_WORDS = ["PVT", "LTD", "LLC", "INC", "CORP", "COMPANY", "TECHNOLOGIES", "SOFTWARE", "SOLUTIONS", "DEVELOPER", "ENGINEER", "MANAGER", "LEAD", "SENIOR", "JUNIOR", "ARCHITECT", "CONSULTANT", "ANALYST"]
JOB_WORDS = ["DEVELOPER", "ENGINEER", "MANAGER", "LEAD", "SENIOR", "JUNIOR", "ARCHITECT", "CONSULTANT", "ANALYST", "SPECIALIST", "DESIGNER"]
SENTENCE_TITLE = r"^(?:Developers, Testers|Collaborated|Designed|Led and|Completed|Contributed)|[Ee]nsure|[Ss]eamless|[Cc]oordination|,.*,|and.*and"
DEGREES = [r"(?i)(?:bachelor|\bb\.?s\.?\b|\bb\.?tech)", r"(?i)(?:master|\bm\.?s\.?\b|\bm\.?tech|\bmba\b)", r"(?i)(?:phd|ph\.d|doctorate)", r"(?i)(?:diploma|certificate)"]
INSTITUTION = r"[A-Z][A-Za-z ]+(?:University|College|Institute|School|Academy)"
PROJECT_TECHNOLOGIES = [
    "Python", "Java", "JavaScript", "React", "Node", "Django", "Flask", "AWS", "Docker", "Kubernetes", "MongoDB", "PostgreSQL", "MySQL",
    "TensorFlow", "PyTorch", "Machine Learning", "AI", "Deep Learning", "Angular", "Vue", "Next.js", "TypeScript", "FastAPI", "NestJS",
]
SUMMARY_WORDS = r"(?i)\b(?:versatile|senior|developer|experience|years|proven|leader|projects)\b"
SUMMARY_NAMES = ["profile summary", "summary", "objective", "about"]
CATEGORY_BARRED = r"(?i)\b(?:and|with|to|for|the|a|an|is|are|was|were|contributed|developed|created|maintaining|enhance|solving|approaches|scalability|leader|complete)\b"
CATEGORY_STOP = r"(?is)\b(?:contributed|developed|created|built|designed|handled|managed|led|worked|delivered|ensured|improved|optimized|implemented|architected|maintained|supported|collaborated|participated|achieved|reduced|increased|scaled|deployed|configured|monitored|tested|wrote|documented)\b.*$"
NAME_BARRED = [
    "email", "phone", "address", "linkedin", "github", "experience", "education", "skills", "objective", "summary", "profile", "@", "http", "www",
    "developer", "engineer", "manager", "designer", "analyst", "specialist", "architect", "consultant", "lead", "senior", "junior", "full", "stack", "programmer", "coder",
    "projects", "certifications", "languages", "contact", "work", "resume", "curriculum",
]
URL = r"(?:https?://)?(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})*(?:/[a-zA-Z0-9_/.-]*)?"
MAIL_HOSTS = ["gmail", "yahoo", "hotmail", "outlook", "icloud", "aol", "mail"]
OTHER_SITES = ["behance.net", "dribbble.com", "medium.com", "dev.to", "hashnode.com", "kaggle.com", "stackoverflow.com", "twitter.com", "x.com"]
CONTENT_TITLES = r"(?i)\b(?:senior|junior|lead|principal|staff|associate|software|full stack|frontend|backend|devops|data|cloud|product|project|business|technical)\s+[a-z]+"
CONTENT_COMPANIES = r"(?i)\b(?:pvt|ltd|llc|inc|corp|corporation|technologies|solutions|services|systems|group|company|co)\b"
CONTENT_WORK = ["led", "developed", "designed", "implemented", "managed", "created", "built", "delivered", "improved", "optimized", "collaborated", "worked", "responsibilities", "achievements"]
CONTENT_SCHOOL = ["bachelor", "master", "phd", "ph.d", "doctorate", "mba", "mca", "bsc", "msc", "btech", "mtech", "degree", "diploma", "certificate", "university", "college", "institute", "school", "academy"]
CONTENT_TECH = ["react", "angular", "vue", "python", "java", "javascript", "node", "django", "flask", "sql", "mongodb", "postgresql", "docker", "kubernetes", "aws", "azure"]
CONTENT_TECH_LIST = r"(?i)(?:frontend|backend|database|devops|tools|technologies|languages|frameworks|platforms|software)[:\s]+"
CONTENT_PROJECT = ["project", "portfolio", "github", "gitlab", "demo", "application", "website", "app", "system"]
CONTENT_ENDS = {
    "experience": ["EDUCATION", "PROJECTS", "SKILLS", "CERTIFICATIONS"],
    "education": ["PROJECTS", "SKILLS", "CERTIFICATIONS", "CONTACT", "PROFILE"],
    "skills": ["CONTACT", "PROFILE", "PROJECTS", "REFERENCES"],
    "projects": [],
}
POST_REQUIRED = r"(?is)(?:required\s+skills?|must\s+have|requirements?|qualifications?)[:\s]+(.*?)(?:\n\n|\n(?:nice|preferred|bonus)|\z)"
POST_NICE = r"(?is)(?:nice\s+to\s+have|preferred|bonus|plus|advantage)[:\s]+(.*?)(?:\n\n|\z)"
POST_MUST = r"\b(?:must|required|essential|need)"
POST_MAY = r"\b(?:preferred|nice|bonus|plus|advantage)"
LEADERSHIP_INFERRED = ["lead", "principal", "staff", "manager", "director", "vp", "chief"]
