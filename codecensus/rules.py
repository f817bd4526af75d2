"""Rule and lookup tables.

Everything in this module is a fixed value: the lists decide results, so they are stated as
plain text, in one place, and every operator that uses one takes it as an argument that
defaults to the table here.
"""

from __future__ import annotations

# --- fixed values: which files are worth reading -------------------------------------------

CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs",
    ".rb", ".go", ".rs", ".java", ".php", ".c", ".cpp", ".h", ".cs",
    ".swift", ".kt", ".dart", ".lua", ".r", ".pl", ".sh", ".bat", ".ps1",
    ".html", ".htm", ".css", ".scss", ".sass", ".less", ".styl",
    ".vue", ".svelte", ".ejs", ".pug", ".hbs", ".handlebars", ".mustache",
    ".astro", ".mdx",
    ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".xml",
    ".env", ".env.example", ".env.local", ".env.development", ".env.production",
    ".conf", ".properties", ".editorconfig",
    ".sql", ".prisma", ".graphql", ".gql", ".proto",
    ".md", ".txt", ".rst", ".csv",
    ".lock", ".npmrc", ".nvmrc", ".babelrc",
    ".dockerfile", ".svg",
)

IMPORTANT_FILES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "Pipfile", "Pipfile.lock", "pyproject.toml", "setup.py", "setup.cfg",
    "docker-compose.yml", "docker-compose.yaml", "Dockerfile",
    ".env", ".env.example", ".env.local", ".env.development",
    "config.py", "settings.py", "config.js", "config.ts",
    "schema.prisma", "models.py", "schemas.py", "database.py",
    "tsconfig.json", "jsconfig.json", "next.config.js", "next.config.mjs", "next.config.ts",
    "vite.config.js", "vite.config.ts", "webpack.config.js",
    "tailwind.config.js", "tailwind.config.ts", "postcss.config.js", "postcss.config.mjs",
    "eslint.config.js", "eslint.config.mjs", ".eslintrc.js", ".eslintrc.json",
    ".prettierrc", ".prettierrc.json", ".prettierrc.js",
    "Makefile", "Procfile", "Gemfile", "Gemfile.lock",
    ".gitignore", ".dockerignore", "vercel.json", "netlify.toml",
    "babel.config.js", "jest.config.js", "jest.config.ts",
    "vitest.config.ts", "playwright.config.ts",
)

PATH_HINTS = ("model", "schema", "route", "api", "controller")

SKIP_DIRS = (
    "node_modules", "venv", ".venv", "__pycache__", ".git",
    "dist", "build", ".next", ".nuxt", "coverage", ".cache",
    "vendor", "bower_components", ".tox", "egg-info", ".eggs",
)

BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".webp",
    ".mp3", ".mp4", ".wav", ".avi", ".mkv", ".mov",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".pyc", ".pyo", ".so", ".dll", ".exe", ".o",
    ".DS_Store", ".map",
)

MAX_FILE_BYTES = 500_000
MAX_NUL_SHARE = 0.1
LOW_COVERAGE = 0.3

# --- fixed values: language by extension and by whole name ---------------------------------

LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".ts": "typescript",
    ".tsx": "typescript-react", ".jsx": "javascript-react",
    ".mjs": "javascript", ".cjs": "javascript",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".html": "html", ".htm": "html", ".css": "css",
    ".scss": "scss", ".sass": "sass", ".less": "less",
    ".sql": "sql", ".md": "markdown", ".mdx": "mdx",
    ".xml": "xml", ".svg": "svg", ".vue": "vue", ".svelte": "svelte",
    ".ejs": "ejs", ".pug": "pug", ".hbs": "handlebars",
    ".rb": "ruby", ".go": "go", ".rs": "rust", ".java": "java", ".php": "php",
    ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
    ".dart": "dart", ".lua": "lua", ".sh": "bash", ".bat": "batch", ".ps1": "powershell",
    ".toml": "toml", ".ini": "ini", ".cfg": "ini",
    ".prisma": "prisma", ".graphql": "graphql", ".gql": "graphql",
    ".proto": "protobuf", ".dockerfile": "dockerfile", ".astro": "astro", ".r": "r",
}
LANGUAGE_BY_NAME = {
    "Dockerfile": "dockerfile", "Makefile": "makefile", "Gemfile": "ruby", "Procfile": "yaml",
}
DEFAULT_LANGUAGE = "text"

# --- fixed values: stack detection, (value, substrings of the lower-cased text) --------------

BACKEND_RULES = (
    ("FastAPI", ("fastapi",)),
    ("Flask", ("flask",)),
    ("Express.js", ("express",)),
    ("Django", ("django",)),
)
DATABASE_RULES = (
    ("MongoDB", ("mongodb", "mongoose", "pymongo")),
    ("PostgreSQL", ("postgresql", "psycopg", "pg.")),
    ("MySQL", ("mysql", "pymysql")),
    ("SQLite", ("sqlite",)),
)
FRONTEND_RULES = (
    ("React", ("react",)),
    ("Vue.js", ("vue",)),
    ("Angular", ("angular",)),
    ("Next.js", ("next",)),
)
# databases whose mere mention makes the file one to keep
PRESERVED_DATABASES = ("MongoDB", "PostgreSQL", "MySQL")

SCHEMA_HINTS = ("model", "schema")
CORE_HINTS = ("model", "schema", "database", "db.", "auth", "middleware")
MODERNIZE_HINTS = ("component", "page", "view", "template", "style", "css", "ui")

DECORATOR_MARKERS = ("@app.route", "@app.get", "@app.post")
DECORATOR_ENDPOINT = r"""@app\.(get|post|put|delete|patch)\(['"]([^'"]+)['"]"""
CALL_MARKERS = ("app.get(", "app.post(", "router.get(")
CALL_ENDPOINT = (
    r"""(?:app|router)\.(get|post|put|delete|patch|options)\s*\(\s*['"]([^'"]+)['"]"""
)
ENV_VAR = r"([A-Z_][A-Z0-9_]+)\s*="
ENV_VARS_PER_FILE = 10

# --- fixed values: batching ------------------------------------------------------------------

# model -> (context tokens, characters of source that are safe to send)
MODEL_LIMITS = {
    "gemini-3-flash-preview": (1_048_576, 700_000),
    "gemini-3-pro-preview": (2_097_152, 1_400_000),
    "gemini-2.0-flash-exp": (1_048_576, 600_000),
    "gemini-2.0-flash": (1_048_576, 600_000),
    "gemini-1.5-flash": (1_048_576, 600_000),
    "gemini-1.5-pro": (2_097_152, 1_400_000),
}
DEFAULT_MODEL = "gemini-3-flash-preview"
UNKNOWN_MODEL_CHARS = 400_000
SINGLE_CALL_FILES = 150
SINGLE_CALL_SHARE = 0.7
RECOVERABLE_MISSING = 15

CONFIG_EXTENSIONS = (".json", ".yml", ".yaml", ".toml", ".cfg", ".ini", ".env", ".lock")
CONFIG_NAMES = (
    "package.json", "requirements.txt", "tsconfig.json", ".gitignore",
    "Dockerfile", "docker-compose.yml", ".env", ".env.example",
    "next.config.mjs", "next.config.ts", "tailwind.config.ts",
    "postcss.config.mjs", "eslint.config.mjs", "vite.config.ts",
)
CONFIG_BATCH = "Config & Dependencies"
ROOT_BATCH = "Root Files"
REMAINING_BATCH = "Remaining Files"

# --- fixed values: signatures of source lines ------------------------------------------------

SIGNATURE_PREFIXES = (
    "export ", "module.exports", "exports.",
    "function ", "const ", "class ",
    "app.get(", "app.post(", "app.put(", "app.delete(", "app.patch(",
    "router.get(", "router.post(", "router.put(", "router.delete(",
    "def ", "@app.route", "@router.",
)
IMPORT_PREFIXES = ("import ", "from ", "require(", "const {")
SIGNATURE_CHARS = 120
SIGNATURES_PER_FILE = 30
NO_SIGNATURE = "[config/static file]"

# --- fixed values: dependencies --------------------------------------------------------------

PACKAGE_BY_IMPORT = {
    "numpy": "numpy",
    "pandas": "pandas",
    "cv2": "opencv-python-headless",
    "PIL": "pillow",
    "sklearn": "scikit-learn",
    "openai": "openai",
    "google.generativeai": "google-generative-ai",
    "fastapi": "fastapi",
    "uvicorn": "uvicorn",
    "flask": "flask",
    "flask_cors": "flask-cors",
    "sqlalchemy": "sqlalchemy",
    "jose": "python-jose[cryptography]",
    "jwt": "python-jose[cryptography]",
    "passlib": "passlib[bcrypt]",
    "bcrypt": "bcrypt==4.0.1",
    "multipart": "python-multipart",
    "dotenv": "python-dotenv",
    "requests": "requests",
    "pydantic": "pydantic",
    "email_validator": "email-validator",
    "bs4": "beautifulsoup4",
}
EMAIL_FIELD_PACKAGES = ("pydantic[email]", "email-validator")
ALWAYS_ON_PACKAGES = ("uvicorn", "fastapi", "python-multipart")
PINNED_PACKAGE = "bcrypt==4.0.1"

# --- fixed values: languages that a fenced block of an answer may name

FENCE_LANGUAGES = ("javascript", "python", "bash")

# --- fixed values: entrypoints and pages -----------------------------------------------------

PYTHON_ENTRYPOINTS = ("main.py", "app.py", "server.py", "run.py", "api.py")
NODE_ENTRYPOINTS = ("server.js", "index.js", "backend.js", "api.js")
BROWSER_MARKERS = ("document.", "window.", "addEventListener", "getElementById")
DEFAULT_ENTRYPOINT = "modernized_stack/backend/main.py"

STATIC_DIR_HINTS = ("public", "static", "views", "templates", "www", "html", "pages")
PAGE_EXTENSIONS = (
    ".html", ".ejs", ".pug", ".jade", ".hbs", ".handlebars", ".jinja2", ".j2", ".php", ".erb",
)
CONFIG_ROLE_NAMES = ("requirements.txt", "package.json", ".env", "Dockerfile")

# --- fixed values: shell-safe paths ----------------------------------------------------------

UNSAFE_PATH_CHARS = "()[]{}@#$&*?!|;<>`'\""

# --- fixed values: error classes, first rule in this order wins --------------------------------

ERROR_RULES = (
    (r"Cannot find module", "NODE_MODULE_NOT_FOUND"),
    (r"Error: Cannot find module", "NODE_MODULE_NOT_FOUND"),
    (r"MODULE_NOT_FOUND", "NODE_MODULE_NOT_FOUND"),
    (r"node:internal/modules", "NODE_INTERNAL_ERROR"),
    (r"throw err;", "NODE_CRASH"),
    (r"ReferenceError:", "NODE_REFERENCE_ERROR"),
    (r"Error: listen EADDRINUSE", "NODE_PORT_IN_USE"),
    (r"ENOENT: no such file", "NODE_FILE_NOT_FOUND"),
    (r"SyntaxError: Unexpected", "NODE_SYNTAX_ERROR"),
    (r"Error: ENOENT", "NODE_FILE_NOT_FOUND"),
    (r"BACKEND_CRASH:", "BACKEND_CRASH"),
    (r"FATAL: Node\.js Backend failed", "NODE_SERVER_CRASH"),
    (r"FATAL: Backend failed", "BACKEND_CRASH"),
    (r"Backend failed to start", "BACKEND_STARTUP_FAILED"),
    (r"No such file or directory", "FILE_NOT_FOUND"),
    (r"can't open file", "FILE_NOT_FOUND"),
    (r"FRONTEND BUILD FAILED", "FRONTEND_BUILD_ERROR"),
    (r"npm ERR!", "NPM_ERROR"),
    (r"error TS\d+:", "TYPESCRIPT_ERROR"),
    (r"SyntaxError:", "SYNTAX_ERROR"),
    (r"Module not found", "MODULE_NOT_FOUND"),
    (r"Sandbox Error:", "SANDBOX_ERROR"),
    (r"Command exited with code [^0]", "COMMAND_FAILED"),
    (r"syntax error near unexpected token", "BASH_SYNTAX_ERROR"),
    (r"mkdir.*failed", "MKDIR_ERROR"),
    (r"Permission denied", "PERMISSION_ERROR"),
    (r"ModuleNotFoundError:", "PYTHON_IMPORT_ERROR"),
    (r"ImportError:", "PYTHON_IMPORT_ERROR"),
    (r"IndentationError:", "PYTHON_SYNTAX_ERROR"),
    (r"NameError:", "PYTHON_NAME_ERROR"),
    (r"TypeError:", "PYTHON_TYPE_ERROR"),
    (r"FileNotFoundError:", "PYTHON_FILE_NOT_FOUND"),
    (r"ECONNREFUSED", "CONNECTION_ERROR"),
    (r"Failed to connect", "CONNECTION_ERROR"),
    (r"Backend connection failed", "BACKEND_ERROR"),
    (r"GENERATION FAILED", "GENERATION_ERROR"),
    (r"No files were generated", "EMPTY_GENERATION"),
    (r"MongoNetworkError", "DATABASE_CONNECTION_ERROR"),
    (r"MongoServerError", "DATABASE_ERROR"),
    (r"ECONNREFUSED.*27017", "MONGODB_CONNECTION_ERROR"),
)
ERROR_CONTEXT_BEFORE = 200
ERROR_CONTEXT_AFTER = 500
CRASH_INDICATORS = (
    "SyntaxError", "ImportError", "ModuleNotFoundError",
    "NameError", "IndentationError", "AttributeError: module",
)

LESSON_RULES = (
    ("NODE_MODULE_NOT_FOUND",
     "Ensure npm install runs in the correct directory where dependencies are expected."),
    ("FRONTEND_BUILD_ERROR",
     "Check for TypeScript errors and missing dependencies before building."),
    ("NODE_CRASH", "Verify all required modules are installed and paths are correct."),
    ("MONGODB_CONNECTION_ERROR",
     "MongoDB connection string may need updating or the database server may be unreachable."),
    ("SYNTAX_ERROR", "Code has syntax issues - review generated code for typos."),
    ("PORT_IN_USE", "The port is already in use - try a different port."),
    ("FILE_NOT_FOUND", "A required file is missing - check file paths."),
    ("PYTHON_IMPORT_ERROR", "Python module not installed - add to requirements.txt."),
    ("BACKEND_CRASH", "Server crashed on startup - check logs for details."),
)
DEFAULT_LESSON = "Review the error and adjust the approach accordingly."

MAX_ATTEMPTS = 4
FALLBACK_MARKERS = ("Sandbox Error", "BUILD FAILED", "FATAL ERROR")
STATUS_OK = "Resurrected"
STATUS_FALLBACK = "Fallback"
STATUS_ERROR = "Error"
EXCEPTION = "EXCEPTION"
ERROR_MESSAGE_IN_CONTEXT = 1000

# --- fixed values: retention of the attempt memory ---------------------------------------------

KEEP_FAILURES = 10
KEEP_DECISIONS = 20
KEEP_PATTERNS = 15
KEEP_HISTORY = 10
ERROR_MESSAGE_CHARS = 500
ERROR_NOTE_CHARS = 300

# --- fixed values: images ------------------------------------------------------------------------

IMAGE_FILE_EXTENSIONS = (
    ".html", ".htm", ".tsx", ".jsx", ".css", ".scss", ".vue", ".svelte",
)
IMG_TAG = r"""<img\s+[^>]*src\s*=\s*["']([^"']*)["'][^>]*>"""
BACKGROUND_IMAGE = r"""background(?:-image)?\s*:\s*url\(["']?([^"')\s]+)["']?\)"""
JSX_IMAGE = r"""<(?:img|Image)\s+[^>]*src\s*=\s*\{?\s*["']([^"'{}]*)["']"""
ALT_TEXT = r"""alt\s*=\s*["']([^"']*)["']"""
PLACEHOLDER_SRC = (
    "placeholder", "via.placeholder", "placehold", "picsum",
    "dummyimage", "fakeimg", "lorempixel", "placekitten",
    "fillmurray", "placecage", "loremflickr",
    "example.com", "test.png", "image.png", "logo.png",
    "#", "about:blank", "data:image/svg",
)
CONVERSATIONAL_PHRASES = (
    "want to", "want ti", "i want", "can you", "please", "make me",
    "set up", "set a", "create a", "give me", "help me", "need a",
    "generate a", "build a", "design a", "for this", "for the",
    "for my", "analyse", "analyze", "should be", "would be",
    "this website", "the website", "the app", "this app",
)
EXTENSION_BY_MIME = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/svg+xml": ".svg",
    "image/webp": ".webp", "image/gif": ".gif",
}

# --- fixed values: linked assets and rewrites -----------------------------------------------------

STYLESHEET_LINK = (
    r"""<link[^>]*rel=["']stylesheet["'][^>]*href=["']([^"'>]+)["'][^>]*/?>"""
    r"""|<link[^>]*href=["']([^"'>]+)["'][^>]*rel=["']stylesheet["'][^>]*/?>"""
)
SCRIPT_LINK = r"""<script[^>]*src=["']([^"'>]+)["'][^>]*>\s*</script>"""
LOCAL_URL = (
    r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0):(?:8000|5000|3001|8080|5001|4000)\b"
)
REWRITE_EXTENSIONS = (
    ".html", ".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".mjs", ".cjs", ".css",
)
FINAL_REWRITE_EXTENSIONS = REWRITE_EXTENSIONS[:-1]

# --- fixed values: multi-file answers ---------------------------------------------------------------

FILE_TAG_DOUBLE = r"""<file\s+path="(.*?)">(.*?)</file>"""
FILE_TAG_ANY_QUOTE = r"""<file\s+path=['"]([^'"]+)['"]>(.*?)</file>"""
FILE_TAG_SPACED = r"""<file\s+path\s*=\s*"([^"]+)"\s*>(.*?)</file\s*>"""
FILE_TAG_OPENING = r"""<file\s+path\s*=\s*["']([^"']+)["']"""

# --- fixed values: token classes ---------------------------------------------------------------------

TOKEN_LANGUAGE_BY_EXTENSION = {
    "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "mjs": "js",
    "py": "py", "pyw": "py",
    "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sass": "css",
    "json": "json",
}
SCRIPT_KEYWORDS = (
    "import", "export", "from", "default", "const", "let", "var", "function", "return",
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue",
    "try", "catch", "finally", "throw", "new", "delete", "typeof", "instanceof",
    "class", "extends", "super", "this", "async", "await", "yield",
    "true", "false", "null", "undefined", "void", "of", "in", "as", "type", "interface",
    "enum", "implements", "readonly", "public", "private", "protected", "static",
)
PYTHON_KEYWORDS = (
    "import", "from", "def", "class", "return", "if", "elif", "else", "for",
    "while", "try", "except", "finally", "raise", "with", "as", "pass",
    "break", "continue", "and", "or", "not", "is", "in", "lambda", "yield",
    "True", "False", "None", "self", "async", "await", "global", "nonlocal",
    "del", "assert",
)

# --- fixed values: log levels ---------------------------------------------------------------------------

LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
LOG_BUFFER = 2000
CHECKPOINT_WAIT_SECONDS = 600
EVENT_TYPES = (
    "session", "log", "debug", "files", "repo_files", "checkpoint", "analysis", "result", "error",
)
