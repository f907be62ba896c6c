"""Review comments, combined feedback, prompts and answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffscope.functions.text import not_blank, splitlines, word_count
from diffscope.operators.labels import canonical_issues

# Comment texts.
ISSUE_MESSAGES = {
    "very_long_change": "📏 Consider breaking this large change into smaller, more focused commits",
    "no_comments": "📝 Adding comments would improve code readability and maintainability",
    "debug_prints": "🐛 Remove debug print statements before committing",
    "long_lines": "📐 Some lines exceed recommended length. Consider breaking them up",
    "deep_nesting": "🔄 Deep nesting detected. Consider refactoring to reduce complexity",
    "unparseable_syntax": "❌ Syntax errors detected. Please review the code",
    "todo_markers": "📋 TODO/FIXME comments found. Consider addressing them",
}
MODEL_FLAG = "⚠️ %s model flags this code as potentially problematic (confidence: %.2f)"
SCORE_CONCERN = "🤖 CodeBERT analysis suggests code quality concerns (score: %.2f)"
SCORE_GOOD = "✅ CodeBERT analysis indicates good code quality (score: %.2f)"
COMPLEX = "🔧 High cyclomatic complexity detected. Consider refactoring into smaller functions"
MANY_FUNCTIONS = "🏗️ Multiple functions in one change. Consider separating concerns"
ALL_GOOD = "✅ Code looks good! No significant issues detected"
LARGE_CHANGE = "Large change detected - consider breaking into smaller commits"
HAS_TODO = "Contains TODO/FIXME - ensure these are addressed"
HAS_DEBUG = "Debug statements detected - remove before production"
NOTHING_FOUND = "No specific issues detected"
NO_REMOVED = "[No removed code]"
ANSWER_PREFIXES = {
    "assessment": "AI Assessment: ", "issues": "Potential Issues: ", "recommendations": "Recommendations: ",
    "security": "Security: ", "performance": "Performance: ",
}
ANSWER_DDL = ("struct<assessment:string,issues:string,recommendations:string,security:string,performance:string,"
              "analysis:string,error:string>")
PROMPT = """
        Analyze this code change and provide specific technical feedback:

        File: %s

        Removed code:
        ```
        %s
        ```

        Added code:
        ```
        %s
        ```

        Context:
        ```
        %s
        ```

        Please provide:
        1. Technical assessment of the change quality
        2. Potential issues or improvements
        3. Best practice recommendations
        4. Security considerations if applicable
        5. Performance implications

        Respond in strict JSON with keys: assessment, issues, recommendations, security, performance.
        """


def model_comment(name: str, prediction: Column, probability: Column) -> Column:
    """Comment when a model predicts low quality with more than 0.7 confidence in that class; else null."""
    confidence = 1 - probability
    return F.when((prediction == 0) & (confidence > 0.7), F.format_string(MODEL_FLAG, F.lit(name.title()), confidence))


def score_comment(score: Column) -> Column:
    """Comment on a quality score in [0, 1]; null between 0.6 and 0.8."""
    return (F.when(score < 0.6, F.format_string(SCORE_CONCERN, score.cast("double")))
            .when(score > 0.8, F.format_string(SCORE_GOOD, score.cast("double"))))


def issue_comments(issues: Column) -> Column:
    """Messages of the known issues, in issue order."""
    messages = F.create_map(*[F.lit(x) for pair in ISSUE_MESSAGES.items() for x in pair])
    return F.array_compact(F.transform(canonical_issues(issues), lambda i: F.try_element_at(messages, i)))


def syntax_comments(complexity: Column, functions: Column) -> Column:
    return F.array_compact(F.array(F.when(complexity > 10, COMPLEX), F.when(functions > 5, MANY_FUNCTIONS)))


def review_comments_array(issues: Column, complexity: Column, functions: Column, models: list[Column] = (),
                          score: Column | None = None) -> Column:
    """All comments of a hunk in their fixed order; one positive comment when there are none."""
    first = [*models, *([score_comment(score)] if score is not None else [])]
    parts = [F.array_compact(F.array(*first))] if first else []
    comments = F.concat(*parts, issue_comments(issues), syntax_comments(complexity, functions))
    return F.when(F.size(comments) == 0, F.array(F.lit(ALL_GOOD))).otherwise(comments)


def change_line(removed: Column, added: Column, word_counts: bool = False) -> Column:
    """What kind of change it is, with line counts (`word_counts` for counts of words in modified code)."""
    def lines(text):
        return F.size(splitlines(text)).cast("string")

    before = word_count(removed).cast("string") if word_counts else lines(removed)
    after = word_count(added).cast("string") if word_counts else lines(added)
    has_added, has_removed = added != "", removed != ""
    return (F.when(has_added & has_removed, F.concat(F.lit("Modified "), before, F.lit(" -> "), after, F.lit(" lines")))
            .when(has_added, F.concat(F.lit("Added "), lines(added), F.lit(" new lines")))
            .when(has_removed, F.concat(F.lit("Removed "), lines(removed), F.lit(" lines"))))


def pattern_feedback(added: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.size(splitlines(added)) > 20, LARGE_CHANGE),
        F.when(added.contains("TODO") | added.contains("FIXME"), HAS_TODO),
        F.when(added.contains("print(") | added.contains("console.log"), HAS_DEBUG)))


def answer_feedback(answer: Column) -> Column:
    """Lines from a parsed external answer; none when it is missing or carries an error."""
    lines = F.array_compact(F.array(*[
        F.when(answer[field].isNotNull() & (answer[field] != ""), F.concat(F.lit(prefix), answer[field]))
        for field, prefix in ANSWER_PREFIXES.items()]))
    usable = answer.isNotNull() & answer["error"].isNull()
    return F.when(usable, lines).otherwise(F.array().cast("array<string>"))


def combined_feedback(removed: Column, added: Column, comments: Column, answer: Column | None = None,
                      word_counts: bool = False) -> Column:
    """Change line, local comments, external answer, pattern feedback; a fixed text when all are empty."""
    none = F.array().cast("array<string>")
    feedback = F.concat(
        F.array_compact(F.array(change_line(removed, added, word_counts))),
        F.coalesce(comments, none),
        answer_feedback(answer) if answer is not None else none,
        pattern_feedback(added))
    return F.when(F.size(feedback) == 0, F.array(F.lit(NOTHING_FOUND))).otherwise(feedback)


def review_prompt(path: Column, removed: Column, added: Column, context: Column) -> Column:
    """Prompt for an external reviewer."""
    shown = F.when(removed == "", NO_REMOVED).otherwise(removed)
    return F.format_string(PROMPT, path, shown, added, context)


def strip_fence(text: Column) -> Column:
    """Remove a fenced-block marker around a JSON answer."""
    return F.trim(F.regexp_replace(text, F.lit(r"(?m)^```(json)?\s*$|```\s*$"), F.lit("")))


def parse_review(text: Column) -> Column:
    """Answer text to a struct: JSON fields, or the raw text as `analysis` when it is not a JSON object.

    A JSON list or object inside a field stays as its JSON text.
    """
    raw = F.regexp_replace(text, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    content = strip_fence(raw)
    is_object = F.try_parse_json(content).isNotNull() & content.rlike(r"^\s*\{")
    parsed = F.from_json(content, ANSWER_DDL)
    fallback = F.struct(*[F.lit(None).cast("string").alias(f) for f in ANSWER_PREFIXES], raw.alias("analysis"),
                        F.lit(None).cast("string").alias("error"))
    return F.when(text.isNotNull(), F.when(is_object, parsed).otherwise(fallback))


def reviewable(added: Column, removed: Column) -> Column:
    """True if there is any code to send to an external reviewer."""
    return not_blank(added) | not_blank(removed)
