"""Classification by phrases. The patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIGGERS = {
    "durable": r"(?i)(?:默认|以后|一直|通常|习惯|长期|always|normally|default|prefer)",
    "correction": r"(?i)(?:不是|不对|改成|更新为|现在是|不再|changed\s+to|instead)",
    "commitment": r"(?i)(?:统一使用|以后都|必须|固定使用|shall|always\s+use)",
    "speculative": r"(?i)(?:可能|也许|试试|考虑|maybe|perhaps|try)",
    "transient": r"(?i)(?:现在先|这次先|暂时|今天|today|for\s+now)",
    "preference": r"(?i)(?:我(?:一般|通常|一直|更)?(?:喜欢|偏好|不喜欢)|i\s+(?:usually\s+)?prefer)",
    "question": r"(?i)(?:[?？]\s*$|^(?:是否|能否|可以吗|why\b|how\b|what\b))",
}
RESEARCH = r"(?i)\b(?:research|investigate|compare sources|paper|study)\b|研究|调研|查资料"
PLANNING = r"(?i)\b(?:plan|roadmap|schedule|organize)\b|计划|规划|安排"
OPERATION = r"(?i)^\s*[!/]|\b(?:deploy|restart|install|run command)\b|部署|重启|安装"
_NAMED = r"(?:\bmemory\b|\bartifact\b|记忆|工件|证据)"
_NUMBER = r"(?:\bid\b|编号)[^\n]{0,8}\b[a-f0-9]{64}\b"
ANCHORED = (rf"(?i){_NAMED}[^\n]{{0,32}}{_NUMBER}", rf"(?i){_NUMBER}[^\n]{{0,32}}{_NAMED}")


def triggers(text: Column) -> list[Column]:
    """Flags of what a statement may carry, whether it is worth analysing, and its source label."""
    flag = {name: text.rlike(pattern) for name, pattern in TRIGGERS.items()}
    lasting = flag["durable"] | flag["correction"] | flag["commitment"] | flag["preference"]
    analyse = lasting & ~flag["speculative"] & ~flag["transient"] & ~flag["question"]
    source = F.when(flag["correction"], "user_correction").when(flag["commitment"], "user_commitment").otherwise("user_statement")
    return [*(c.alias(n) for n, c in flag.items()), analyse.alias("analyse"), source.alias("source")]


def interaction_mode(prompt: Column, has_workspace: Column) -> Column:
    modes = F.when(prompt.rlike(RESEARCH), "research").when(prompt.rlike(PLANNING), "planning").when(prompt.rlike(OPERATION), "operation")
    return modes.when(has_workspace, "coding").when(F.btrim(prompt) == "", "unknown").otherwise("conversation")


def recall_gate(prompt: Column, is_command: Column, remaining: Column, most: int = 1600) -> list[Column]:
    short = F.char_length(F.btrim(prompt)) < 2
    reason = F.when(is_command, "command-input").when(short, "insufficient-query-signal").otherwise("classless-fast-recall")
    budget = F.when(is_command | short, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), remaining)))
    return [reason.alias("reason"), budget.alias("budget"), (prompt.rlike(ANCHORED[0]) | prompt.rlike(ANCHORED[1])).alias("anchored")]

# Phrases that ask for maintenance, and that ask for something else; fixed values.
MAINTENANCE = (
    "诊断", "检查存储", "检查仓库", "检查库", "备份记忆", "备份记忆库", "备份存储", "迁移记忆库", "迁移存储", "迁移记忆",
    "修复 artifact", "修复产物", "修复 Artifact", "修复损坏", "清理损坏", "清理过期", "导出记忆", "导出长期记忆", "导出存储",
    "检查内部存储", "检查索引", "检查 Manifest", "修复索引", "重建索引", "统计记忆", "统计记录数", "安全审计", "权限检查",
    "diagnose", "diagnostic", "check store", "check storage", "inspect store", "backup memory", "backup storage", "migrate memory", "migrate storage",
    "repair artifact", "fix artifact", "repair corruption", "clean expired", "export memory", "export storage", "check internal",
    "check index", "rebuild index", "memory statistics", "record count", "security audit", "permission check", "maintenance mode", "maintenance",
)
OTHERWISE = (
    "帮我看看", "查看", "查询", "找一下", "搜索", "这条记录", "那条记录", "看看记录", "有什么", "是什么", "怎么样", "告诉我", "解释", "说明",
    "read", "show", "find", "search", "look up", "what is", "tell me", "explain", "spark:",
)
RESOURCE_ID = r"(?i)\b[a-f0-9]{16,64}\b"


def access_intent(text: Column) -> list[Column]:
    """What a text asks for, with a confidence: maintenance, a search, a resource by id, or nothing."""
    lower = F.lower(text)
    asked = sum((F.contains(lower, F.lit(p)).cast("int") for p in MAINTENANCE), F.lit(0))
    other = F.lit(False)
    for phrase in OTHERWISE:
        other = other | F.contains(lower, F.lit(phrase))
    search = (asked == 1) & other
    none = F.when(text.rlike(RESOURCE_ID), "explicit_id").when(F.btrim(text) != "", "semantic_search").otherwise("automatic_recall")
    intent = F.when(asked == 0, none).when(search, "semantic_search").otherwise("maintenance")
    sure = F.when(asked == 0, F.when(none == "explicit_id", 0.6).when(none == "semantic_search", 0.5).otherwise(0.3)).when(search, 0.5).when(asked >= 2, 0.9).otherwise(0.75)
    return [intent.alias("intent"), sure.alias("confidence")]
