"""Lists, limits, names and patterns that results depend on."""

# Extensions read as code and as documentation.
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".hpp", ".go", ".rs",
    ".jsx", ".tsx", ".html", ".css", ".php", ".swift", ".cs",
]
DOC_EXTENSIONS = [".md", ".txt", ".rst", ".json", ".yaml", ".yml"]

# Extension -> parser language.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".java": "java", ".c": "c_cpp", ".h": "c_cpp", ".cpp": "c_cpp", ".hpp": "c_cpp",
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".php": "php", ".swift": "swift", ".cs": "csharp",
}

# Directories and files left out by default.
EXCLUDED_DIRS = [
    "./.venv/", "./venv/", "./env/", "./virtualenv/",
    "./node_modules/", "./bower_components/", "./jspm_packages/",
    "./.git/", "./.svn/", "./.hg/", "./.bzr/",
    "./__pycache__/", "./.pytest_cache/", "./.mypy_cache/", "./.ruff_cache/", "./.coverage/",
    "./dist/", "./build/", "./out/", "./target/", "./bin/", "./obj/",
    "./docs/", "./_docs/", "./site-docs/", "./_site/",
    "./.idea/", "./.vscode/", "./.vs/", "./.eclipse/", "./.settings/",
    "./logs/", "./log/", "./tmp/", "./temp/",
]
EXCLUDED_FILES = [
    "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock",
    "Pipfile.lock", "requirements.txt.lock", "Cargo.lock", "composer.lock",
    ".lock", ".DS_Store", "Thumbs.db", "desktop.ini", "*.lnk", ".env",
    ".env.*", "*.env", "*.cfg", "*.ini", ".flaskenv", ".gitignore",
    ".gitattributes", ".gitmodules", ".github", ".gitlab-ci.yml",
    ".prettierrc", ".eslintrc", ".eslintignore", ".stylelintrc",
    ".editorconfig", ".jshintrc", ".pylintrc", ".flake8", "mypy.ini",
    "pyproject.toml", "tsconfig.json", "webpack.config.js", "babel.config.js",
    "rollup.config.js", "jest.config.js", "karma.conf.js", "vite.config.js",
    "next.config.js", "*.min.js", "*.min.css", "*.bundle.js", "*.bundle.css",
    "*.map", "*.gz", "*.zip", "*.tar", "*.tgz", "*.rar", "*.7z", "*.iso",
    "*.dmg", "*.img", "*.msix", "*.appx", "*.appxbundle", "*.xap", "*.ipa",
    "*.deb", "*.rpm", "*.msi", "*.exe", "*.dll", "*.so", "*.dylib", "*.o",
    "*.obj", "*.jar", "*.war", "*.ear", "*.jsm", "*.class", "*.pyc", "*.pyd",
    "*.pyo", "__pycache__", "*.a", "*.lib", "*.lo", "*.la", "*.slo", "*.dSYM",
    "*.egg", "*.egg-info", "*.dist-info", "*.eggs", "node_modules",
    "bower_components", "jspm_packages", "lib-cov", "coverage", "htmlcov",
    ".nyc_output", ".tox", "dist", "build", "bld", "out", "bin", "target",
    "packages/*/dist", "packages/*/build", ".output",
]

# Directory and file names hidden from the repository tree.
TREE_HIDDEN_DIRS = ["__pycache__", "node_modules", ".venv"]
TREE_HIDDEN_FILES = ["__init__.py", ".DS_Store"]

# Display names of the answer languages.
LANGUAGE_NAMES = {
    "en": "English",
    "ja": "Japanese (日本語)",
    "zh": "Mandarin Chinese (中文)",
    "zh-tw": "Traditional Chinese (繁體中文)",
    "es": "Spanish (Español)",
    "kr": "Korean (한국어)",
    "vi": "Vietnamese (Tiếng Việt)",
    "pt-br": "Brazilian Portuguese (Português Brasileiro)",
    "fr": "Français (French)",
    "ru": "Русский (Russian)",
}
DEFAULT_LANGUAGE = "en"

# Limits and sizes.
DOC_TOKEN_LIMIT = 819_200
CODE_TOKEN_LIMIT = 8_192_000
CHUNK_WORDS = 1000
CHUNK_OVERLAP = 300
SPLIT_CHARS = 1000
SPLIT_OVERLAP = 300
TOP_K = 30
STORE_TOP_K = 20
EMBED_BATCH = 500
SOCKET_QUESTION_TOKENS = 20_000
HTTP_QUESTION_TOKENS = 8_000
EXTRACT_BYTES_LIMIT = 400 * 1024
CALL_CHAIN_BYTES_LIMIT = 500 * 1024
WIKI_CONTEXT_CHARS = 30_000
FINAL_ITERATION = 5
KEY_METHODS = 50
PATH_DEPTH = 10

# Research markers.
RESEARCH_TAG = "[DEEP RESEARCH]"

# Markers around prompt sections.
CONTEXT_START = "<START_OF_CONTEXT>"
CONTEXT_END = "<END_OF_CONTEXT>"
NO_RETRIEVAL_NOTE = "<note>Answering without retrieval augmentation.</note>"

# Keywords that look like a function name or a return type to the line patterns.
CODE_KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "catch", "try", "return", "new", "throw",
    "foreach", "using", "lock", "synchronized", "with", "await", "yield", "typeof", "super", "this",
]

# Page title keywords -> section, first match wins.
SECTION_CATEGORIES = [
    ("overview", "Overview", ["overview", "introduction", "about"]),
    ("architecture", "Architecture", ["architecture", "structure", "design", "system"]),
    ("features", "Core Features", ["feature", "functionality", "core"]),
    ("components", "Components", ["component", "module", "widget"]),
    ("api", "API", ["api", "endpoint", "service", "server"]),
    ("data", "Data Flow", ["data", "flow", "pipeline", "storage"]),
    ("models", "Models", ["model", "ai", "ml", "integration"]),
    ("ui", "User Interface", ["ui", "interface", "frontend", "page"]),
    ("setup", "Setup & Configuration", ["setup", "config", "installation", "deploy"]),
    ("other", "Other", []),
]
IMPORTANCE_SECTIONS = [
    ("high", "Core Components"),
    ("medium", "Key Features"),
    ("low", "Additional Information"),
]

# Line patterns per language.
LINE_PATTERNS = {
    "python": {
        "class": r"^class\s+(\w+)(?:\(([^)]+)\))?:",
        "function": r"^def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([\w\[\],\s]+))?\s*:",
        "import": r"^import\s+(.+)$",
        "from_import": r"^from\s+([\w\.]+)\s+import\s+(.+)",
    },
    "java": {
        "class": r"^\s*(?:public|private|protected)?\s*(?:abstract\s+)?(?:final\s+)?class\s+(\w+)",
        "function": r"^\s*((?:public|private|protected|static|final|abstract|synchronized|native|\s)*)([\w\<\>\[\]]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:\{)?",
        "import": r"^import\s+(?:static\s+)?([\w\.\*]+);",
    },
    "c_cpp": {
        "class": r"^\s*(?:class|struct)\s+(\w+)\s*(?::\s*(?:public|private|protected)\s+\w+)?\s*\{",
        # One repeated class instead of nested repetition: same groups, linear time.
        "function": r"^\s*([\w\s\*]+\s)(\w+)\s*\(([^)]*)\)\s*\{",
        "include": r"^\s*#include\s+(?:<([^>]+)>|\"([^\"]+)\")",
    },
    "javascript": {
        "class": r"^class\s+(\w+)(?:\s+extends\s+[\w]+)?\s*\{",
        "function": r"^(?:function\s+)?(\w+)\s*\(([^)]*)\)\s*\{",
        "arrow_function": r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*\(([^)]*)\)\s*=>",
        "import": r"^import\s+(?:(.+)\s+from\s+)?['\"]([^'\"]+)['\"]",
        "require": r"^\s*(?:const|let|var)\s+.+\s*=\s*require\(['\"]([^'\"]+)['\"]\)",
    },
    "typescript": {
        "class": r"^class\s+(\w+)(?:\s+extends\s+[\w]+)?\s*\{",
        "method": r"^\s*(?:\w+\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*([^{]+))?\s*\{",
        "function": r"^(?:function\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*([^{]+))?\s*\{",
        "arrow_function": r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*\(([^)]*)\)\s*(?::\s*([^{]+))?\s*=>",
        "import": r"^import\s+(?:(.+)\s+from\s+)?['\"]([^'\"]+)['\"]",
        "require": r"^\s*(?:const|let|var)\s+.+\s*=\s*require\(['\"]([^'\"]+)['\"]\)",
    },
    "go": {
        "package": r"^package\s+(\w+)",
        "block_path": r"[\"`]([^\"`]+)[\"`]",
        "import": r"^import\s+(?:\"([^\"]+)\"|`([^`]+)`|([^\s;]+))",
        "function": r"^func\s+(\w+)\s*\(([^)]*)\)\s*(?:\(([^)]*)\))?\s*(?:\{|$)",
        "method": r"^func\s+\(([^)]+)\)\s+(\w+)\s*\(([^)]*)\)\s*(?:\(([^)]*)\))?\s*(?:\{|$)",
    },
    "rust": {
        "function": r"^fn\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^{]+))?\s*\{",
        "use": r"^use\s+([^;]+);",
        "mod": r"^mod\s+(\w+)\s*\{",
    },
    "php": {
        "class": r"^class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[^{]+)?\s*\{",
        "function": r"^function\s+(\w+)\s*\(([^)]*)\)\s*(?::\s*([^{]+))?\s*\{",
        "namespace": r"^namespace\s+([^;]+);",
        "use": r"^use\s+([^;]+);",
    },
    "swift": {
        "class": r"^class\s+(\w+)(?::\s*[^{]+)?\s*\{",
        "function": r"^func\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^{]+))?\s*\{",
        "import": r"^import\s+([^\n]+)",
    },
    "csharp": {
        "class": r"^\s*(?:public|private|protected|internal)?\s*(?:abstract\s+)?(?:sealed\s+)?class\s+(\w+)",
        "function": r"^\s*((?:public|private|protected|static|virtual|override|abstract|\s)*)([\w\<\>\[\]]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:\{)?",
        "namespace": r"^namespace\s+([^{]+)\s*\{",
        "using": r"^using\s+([^;]+);",
    },
    "html": {
        "tag": r"^<(\w+)(?:\s+[^>]*)?>",
        "script": r"^<script(?:\s+[^>]*)?>",
        "style": r"^<style(?:\s+[^>]*)?>",
    },
    "css": {
        "selector": r"^([^{]+)\s*\{",
        "import": r"^@import\s+(?:url\()?[\"']?([^\"'\)]+)[\"']?\)?;",
    },
}

# Line starts that mark a comment.
COMMENT_PREFIXES = {
    "python": ["#"],
    "java": ["//", "/*", "*"], "c_cpp": ["//", "/*", "*"], "javascript": ["//", "/*", "*"],
    "typescript": ["//", "/*", "*"], "go": ["//", "/*", "*"], "rust": ["//", "/*", "*"],
    "php": ["//", "/*", "*"], "swift": ["//", "/*", "*"], "csharp": ["//", "/*", "*"],
    "html": ["<!--"],
    "css": ["/*"],
}

# Repository hosts.
HOST_TYPES = ["github", "gitlab", "bitbucket"]
HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]

# Signs of a finished research answer, and what denies them.
CLOSING_HEADINGS = ["## Conclusion", "## Summary"]
CLOSING_DENIALS = ["I will now proceed to", "Next Steps", "next iteration"]
CLOSING_PHRASES = [
    "This concludes our research",
    "This completes our investigation",
    "This concludes the deep research process",
    "Key Findings and Implementation Details",
    "In conclusion,",
]
TOPIC_PHRASES = ["This Dockerfile", "The Dockerfile"]
TOPIC_DENIALS = ["Next Steps", "In the next iteration"]

# Text added to a last answer without a conclusion; own wording under the heading that marks a conclusion.
COMPLETION_NOTE = "\n\n## Final Conclusion\nThe last round allowed is done. Taken together, the rounds above answer the question."

# Own wording of the time notes in workshop texts.
NOTE_OPEN = '<div class="time-note">\n'
NOTE_CLOSE = "\n</div>\n\n"
PROJECT_NOTE = "Plan half an hour | Uses what the exercises taught"

# Own slides for a plan without readable items.
DEFAULT_SLIDES = [
    "Start: What {repo} is",
    "Purpose: Who uses {repo} and why",
    "Structure: The parts and how they meet",
    "Abilities: What can be done with {repo}",
    "Inside: How the main parts work",
    "First steps: A way to begin with {repo}",
    "End: What to remember",
]

# Provider -> (list key, path of the text in the list's first item); keys tried for other providers.
RESPONSE_PATHS = {
    "anthropic": ("content", "text"),
    "amazon": ("results", "outputText"),
    "cohere": ("generations", "text"),
    "ai21": ("completions", "data.text"),
}
RESPONSE_KEYS = ["text", "content", "output", "completion"]

# Characters Python's str.strip() removes.
PY_WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
