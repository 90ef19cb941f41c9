"""Fixed values of the raw formats: names, markers and limits that results depend on, stated as they are."""

from __future__ import annotations

# --- Typed records ---
RECORD_TYPES = ("user", "assistant", "system", "attachment", "summary", "ai-title", "last-prompt", "queue-operation", "mode", "permission-mode", "file-history-snapshot", "file-history-delta", "agent-name", "pr-link", "relocated", "worktree-state", "bridge-session", "frame-link")
CURRENT_TYPES = ("attachment", "ai-title", "last-prompt", "queue-operation")
LEGACY_TYPES = ("summary",)
EXCLUDING_MARKERS = ("<local-command-stdout>", "<bash-input>", "<bash-stdout>", "<bash-stderr>")
WRAPPER_TAGS = ("command-name", "command-message", "command-args", "local-command-stdout", "bash-input", "bash-stdout", "bash-stderr", "system-reminder")
ORIGINS = ("human", "task-notification")
HUMAN_PROMPTS = ("typed", "queued", "suggestion_accepted")
CLIENT_PROMPTS = ("sdk",)
INTERACTIVE_ENTRYPOINTS = ("cli", "sdk-cli", "claude-desktop", "claude-desktop-3p")

# --- Rollouts ---
INJECTION_PREFIXES = ("<environment_context>", "<user_instructions>", "<ENVIRONMENT_CONTEXT>", "<USER_INSTRUCTIONS>", "<turn_context>", "<permissions", "# AGENTS.md")
HISTORY_MODES = ("legacy", "paginated")
SUBAGENT_KEYS = ("agent_nickname", "agent_path", "agent_role")

# --- Chats ---
CHAT_DOCUMENT_BYTES = 8 * 1024 * 1024
TOOL_KEYS = ("functionCall", "functionResponse", "executableCode", "codeExecutionResult")
MEDIA_KEYS = ("inlineData", "fileData")
MESSAGE_TYPES = ("user", "gemini", "info", "error", "warning")
CHAT_WRAPPER_TAGS = ("session_context", "environment_context", "system_context", "compressed_chat_history", "state_snapshot")
ENVIRONMENT_SENTENCE = "This is the Gemini CLI. We are setting up the context"

# --- Histories ---
ENCODING_RATIO, UNDATED_RATIO = 0.01, 0.5
BANNER = "# aider chat started at "
USER_LINE = "#### "

# --- Stores ---
TEMPLATE_TEXTS = ("Please analyze this codebase and create an AGENTS.md file containing:\n1. Build/lint/test commands - especially for running a single test\n2. Code style guidelines including imports, formatting, types, naming conventions, etc.",)
STATUS_VALUES = ("formatted", "", "empty", "no_audio", "dismissed", "extension_paste", "extension_other")
STATUS_FLAGS = {"dismissed": "dismissed", "extension_paste": "command_mode", "extension_other": "command_mode"}
PK_ANOMALY_RATIO = 0.01

# --- Composers ---
COMPOSER, BUBBLE = "composerData:", "bubbleId:"
COMPOSER_VERSIONS, BUBBLE_VERSION, USER = (10, 16), 3, 1
LEAKS = ("<user_query", "<attached", "<additional_data", "<custom_instructions", "<environment")
NODE_TYPES = ("root", "paragraph", "text", "mention", "tab", "linebreak")
MENTION_NAME_KEYS = ("mentionName", "name", "label", "text")
VERBATIM_GATES = ("verbatim_exact", "verbatim_whitespace", "verbatim_mention_sigil")
MISSING_SHARE, MALFORMED_SHARE, ODD_VERSION_SHARE, MISMATCH_SHARE = 10, 10, 2, 4

# --- Task folders ---
WRAPPERS = ("task", "feedback", "answer", "user_message")
INJECTED_BLOCKS = ("<environment_details>", "<file_content", "<folder_content", "<url_content", "<workspace_diagnostics>")
MENTION_TAGS = ("<file_content", "<url_content", "<folder_content")
MENTION_MARKER = r"\(see below for [^)]{0,60}content\)"
INSTRUCTIONS = r"(?s)<explicit_instructions\b[^>]*>.*?</explicit_instructions>"
API_HISTORY, HISTORY_ITEM, TASK_UI, LEGACY_UI = "api_conversation_history.json", "history_item.json", "ui_messages.json", "claude_messages.json"

# --- Quotas ---
QUOTA_WINDOWS = ("five_hour", "seven_day")
QUOTA_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
QUOTA_AGE_LIMIT = 60 * 60

# --- Session folders ---
MESSAGES_SUFFIX = ".messages.json"
MODE_NOTICE = r"(?s)<mode_notice>.*?</mode_notice>"
USER_INPUT = r"(?s)<user_input\b[^>]*>(.*?)</user_input>"
USER_COMMAND = "<user_command"
COMPOSED_PREFIXES = ("System-delivered teammate async run updates:",)

# --- Fingerprints ---
HISTORY_REQUIRED = ("transcriptEntityId", "asrText", "timestamp")
HISTORY_OPTIONAL = ("app", "language", "conversationId", "status", "isArchived", "appVersion", "numWords", "duration")
KNOWN_EXTRA_TABLES = ("dictionary", "polish", "notes", "note_versions", "note_images", "meetings", "meeting_versions", "calendar_events", "links", "snippets", "notifications", "remotenotifications")
