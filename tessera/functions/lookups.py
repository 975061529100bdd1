"""Fixed values that decide results: names, extensions, patterns and ranks."""

from __future__ import annotations

# Ranks of risk levels, most severe first.
RISKS = ("HIGH", "MEDIUM", "LOW")

# Language by file extension.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "groovy": "groovy",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "vue": "vue", "svelte": "svelte", "css": "css", "scss": "scss", "less": "less", "html": "html",
    "py": "python", "pyi": "python", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "zsh": "shell", "ps1": "powershell", "lua": "lua", "pl": "perl",
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "m": "objective-c",
    "dart": "dart", "ex": "elixir", "exs": "elixir", "erl": "erlang",
    "sql": "sql", "xml": "xml", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "proto": "protobuf", "graphql": "graphql", "gql": "graphql",
    "md": "markdown", "rst": "rst", "adoc": "asciidoc",
}
# Languages that are documents or configuration.
NON_SOURCE = ("markdown", "rst", "asciidoc", "xml", "json", "yaml", "toml")
# Documents by extension and by name, configuration by name and by extension.
DOC_EXTENSIONS = ("md", "markdown", "rst", "adoc", "txt")
DOC_NAMES = ("readme", "license", "licence", "changelog", "notice", "authors", "contributing", "todo")
CONFIG_NAMES = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.json", "package-lock.json", "tsconfig.json",
    "vite.config.js", "vite.config.ts", "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "poetry.lock", "go.mod", "go.sum",
    "cargo.toml", "cargo.lock", "gemfile", "composer.json", "dockerfile", "makefile", "cmakelists.txt", ".gitignore", ".dockerignore", ".editorconfig",
    ".npmrc", ".nvmrc", ".env", ".env.example",
)
CONFIG_EXTENSIONS = ("yml", "yaml", "properties", "toml", "ini", "cfg", "conf", "env", "xml", "json")
# What an import leaves out.
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", "target", "build", "out", "bin", "dist", "classes", "node_modules", "bower_components", "vendor", "__pycache__", ".venv", "venv",
    ".tox", ".pytest_cache", ".mypy_cache", ".gradle", ".mvn", ".idea", ".vscode", ".settings", ".eclipse", ".fleet", ".next", ".nuxt", ".cache",
    ".sass-cache", "coverage", ".nyc_output", ".spike-tmp",
)
EXCLUDED_NAMES = (".ds_store", "thumbs.db", "desktop.ini", ".gitkeep", ".gitattributes")
EXCLUDED_EXTENSIONS = (
    "class", "jar", "war", "ear", "dex", "apk", "aab", "o", "obj", "so", "dll", "dylib", "exe", "bin", "pdb", "pyc", "pyo", "pyd", "log", "tmp", "temp", "bak",
    "swp", "swo", "lock", "pid", "zip", "tar", "gz", "bz2", "7z", "rar", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "avi", "mov",
    "wav", "ttf", "otf", "woff", "woff2", "eot", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "db", "sqlite", "mdb", "dat",
)
MAX_FILE_SIZE = 2 * 1024 * 1024

# Words of a description by which a fix is chosen.
ADVICE_WORDS = {"NULL": ("NPE", "空指针"), "DEAD": ("死代码",), "EXCEPTION": ("catch",), "CONFLICT": ("冲突",)}

# Credentials and connection strings in a line.
CREDENTIAL = r"(?i)(password|passwd|pwd|secret|token|api[-_]?key|access[-_]?key|private[-_]?key)\s*[=:]\s*\S+"
CONNECTION = r"(?i)^(jdbc(:[a-z0-9]+)?|redis|rediss|mongodb(\+srv)?|amqp|amqps|kafka|zookeeper)://\S+"

# Repository hosts.
ALLOWED_HOSTS = ("github.com", "gitee.com", "gitlab.com", "bitbucket.org", "codeberg.org")
SENSITIVE_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "metadata.goog", "instance-data")
SENSITIVE_SUFFIXES = (".local", ".internal", ".localhost")

# Commands that are refused.
DENIED_COMMANDS = (
    r"rm\s+-rf", r":\(\)\s*\{", r"nc\s+-", r"curl\s+.*\|\s*sh", r"wget\s+.*\|\s*sh", r"powershell\s+.*-enc", r"mkfs\.", r"dd\s+if=", r"chmod\s+777", r">/dev/sd", r"bash\s+-i",
)
MAX_COMMAND = 4096

# Layers in order, and the package segments, annotations and name suffixes that tell them.
LAYERS = (
    "CONTROLLER", "SERVICE", "MAPPER", "REPOSITORY", "ENTITY", "DTO", "CONFIG", "CONVERTER", "CLIENT", "UTIL", "EXCEPTION", "CONSTANT", "ASPECT", "TEST", "UNKNOWN",
)
PACKAGE_LAYERS = {
    "controller": "CONTROLLER", "controllers": "CONTROLLER", "web": "CONTROLLER", "api": "CONTROLLER", "service": "SERVICE", "services": "SERVICE",
    "mapper": "MAPPER", "mappers": "MAPPER", "dao": "REPOSITORY", "repository": "REPOSITORY", "repositories": "REPOSITORY",
    "entity": "ENTITY", "entities": "ENTITY", "domain": "ENTITY", "po": "ENTITY",
    "dto": "DTO", "dtos": "DTO", "vo": "DTO", "vos": "DTO", "request": "DTO", "response": "DTO", "query": "DTO", "param": "DTO", "form": "DTO",
    "config": "CONFIG", "configuration": "CONFIG", "properties": "CONFIG", "setting": "CONFIG", "settings": "CONFIG",
    "convert": "CONVERTER", "converter": "CONVERTER", "converters": "CONVERTER", "mapstruct": "CONVERTER",
    "client": "CLIENT", "clients": "CLIENT", "feign": "CLIENT", "remote": "CLIENT", "rpc": "CLIENT",
    "util": "UTIL", "utils": "UTIL", "utility": "UTIL", "helper": "UTIL", "helpers": "UTIL",
    "exception": "EXCEPTION", "exceptions": "EXCEPTION", "error": "EXCEPTION", "errors": "EXCEPTION",
    "constant": "CONSTANT", "constants": "CONSTANT", "aspect": "ASPECT", "aspects": "ASPECT", "aop": "ASPECT",
}
ANNOTATION_LAYERS = {
    "RestController": "CONTROLLER", "Controller": "CONTROLLER", "RestControllerAdvice": "CONTROLLER", "ControllerAdvice": "CONTROLLER", "Service": "SERVICE",
    "Mapper": "MAPPER", "Repository": "REPOSITORY", "Entity": "ENTITY", "TableName": "ENTITY", "Document": "ENTITY", "Configuration": "CONFIG",
    "ConfigurationProperties": "CONFIG", "SpringBootApplication": "CONFIG", "ComponentScan": "CONFIG", "AutoConfiguration": "CONFIG",
    "FeignClient": "CLIENT", "Aspect": "ASPECT",
}
SUFFIX_LAYERS = {
    "ServiceImpl": "SERVICE", "Service": "SERVICE", "Controller": "CONTROLLER", "Resource": "CONTROLLER", "Endpoint": "CONTROLLER", "Mapper": "MAPPER",
    "Repository": "REPOSITORY", "Dao": "REPOSITORY", "Entity": "ENTITY", "DO": "ENTITY", "PO": "ENTITY", "DTO": "DTO", "VO": "DTO", "BO": "DTO", "Request": "DTO",
    "Response": "DTO", "Query": "DTO", "Param": "DTO", "Params": "DTO", "Form": "DTO", "Command": "DTO", "Cmd": "DTO", "Configuration": "CONFIG",
    "Config": "CONFIG", "Properties": "CONFIG", "Settings": "CONFIG", "Converter": "CONVERTER", "Convertor": "CONVERTER", "Assembler": "CONVERTER",
    "FeignClient": "CLIENT", "Client": "CLIENT", "Utils": "UTIL", "Util": "UTIL", "Utility": "UTIL", "Helper": "UTIL", "Tools": "UTIL",
    "Exception": "EXCEPTION", "Error": "EXCEPTION", "Constants": "CONSTANT", "Constant": "CONSTANT", "Aspect": "ASPECT", "Tests": "TEST", "Test": "TEST", "ITCase": "TEST",
}

# Dependencies that need services of their own.
MIDDLEWARE = (
    "redis", "mysql", "mariadb", "postgresql", "postgres", "rabbitmq", "spring-rabbit", "kafka", "nacos", "mongodb", "elasticsearch", "minio", "rocketmq", "activemq",
)

# Annotations of methods that a framework calls, and layers that many types use by design.
CALLBACKS = ("PostConstruct", "PreDestroy", "Scheduled", "EventListener", "EventListenerAdapter", "TransactionalEventListener", "RabbitListener", "KafkaListener", "StreamListener")
WIDELY_USED = ("DTO", "ENTITY", "CONSTANT", "UTIL", "EXCEPTION")

# Actions that a reply may ask for, and their texts.
ACTION_MARKER = "AGENT_ACTIONS_JSON:"
ACTION_SCOPES = ("file", "viewport", "selection")
MOST_ACTIONS, MOST_OPTIONS, LEAST_OPTIONS = 3, 4, 2
SUMMARY_WIDTH, OPTION_WIDTH, PATH_WIDTH, PATH_END = 120, 80, 48, 45
JAVADOC_SUMMARY, CLARIFY_QUESTION, OPEN_FILE, GO_TO = "补充 Javadoc 注释", "请补充一下你的需求", "打开文件 ", "跳转到 "
