"""Pages of known sites: posts, comments, notes, articles and chats found by the sites' own markup.

An extractor looks at the document and the address and returns an :class:`Extract` or
None.  Where a page has too little, some read API answers: ``payloads`` maps an API
address to its body, fetched beforehand.  Nothing here opens a connection.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from ..functions import jsonld
from ..functions.css import select, select_one
from ..functions.dom import Node, escape_attr, inner_html, trim
from ..functions.text import count_words_html, html_escape, integer, strip_html_tags
from .gfm import markdown_to_html

Payloads = Mapping[str, str]


@dataclass
class Extract:
    content: str
    title: str | None = None
    author: str | None = None
    site: str | None = None
    published: str | None = None
    image: str | None = None
    description: str | None = None


@dataclass
class Comment:
    author: str
    date: str
    content: str
    depth: int = 0
    score: str | None = None
    url: str | None = None


def comment_html(c: Comment) -> str:
    date = html_escape(c.date)
    date = f'<a href="{html_escape(c.url)}" class="comment-link">{date}</a>' if c.url is not None else f'<span class="comment-date">{date}</span>'
    score = f' · <span class="comment-points">{html_escape(c.score)}</span>' if c.score is not None else ""
    head = f'<span class="comment-author"><strong>{html_escape(c.author)}</strong></span> · {date}{score}'
    return f'<div class="comment"><div class="comment-metadata">{head}</div><div class="comment-content">{c.content}</div></div>'


def comment_tree(comments: list[Comment]) -> str:
    """Comments in nested quotes by their depths; each comment of depth 0 starts anew."""
    out: list[str] = []
    levels: list[int] = []

    def close(least: int) -> None:
        while levels and levels[-1] >= least:
            levels.pop()
            out.append("</blockquote>")

    for c in comments:
        if c.depth == 0 or (levels and c.depth < levels[-1]):
            close(c.depth)
        if c.depth == 0 or c.depth > (levels[-1] if levels else 0):
            levels.append(c.depth)
            out.append("<blockquote>")
        out.append(comment_html(c))
    close(0)
    return "".join(out)


def post_html(site: str, post: str, comments: list[Comment] | str) -> str:
    comments = comments if isinstance(comments, str) else comment_tree(comments)
    tail = f'<hr><div class="{site} comments"><h2>Comments</h2>{comments}</div>' if comments else ""
    return f'<div class="{site} post"><div class="post-content">{post}</div></div>{tail}'


def _text(root: Node, selector: str, otherwise: str = "") -> str:
    n = select_one(root, selector)
    return trim(n.text()) if n is not None else otherwise


def _html(root: Node, selector: str) -> str:
    n = select_one(root, selector)
    return trim(inner_html(n)) if n is not None else ""


def _attr(root: Node, selector: str, name: str) -> str:
    n = select_one(root, selector)
    return n.get(name) if n is not None else ""


def _meta(doc: Node, name: str) -> str | None:
    n = select_one(doc, f'meta[property="{name}"]')
    return n.attrs.get("content") if n is not None else None


def _has(root: Node, *selectors: str) -> bool:
    return any(select_one(root, s) is not None for s in selectors)


def _day(stamp: Any) -> str:
    return stamp.split("T")[0] if isinstance(stamp, str) else ""


def _cut(text: str, limit: int = 50) -> str:
    return text if len(text) <= limit else text[:limit] + "..."


def _int(text: str) -> int:
    return integer(text) or 0


def _load(payloads: Payloads, url: str) -> Any:
    try:
        return jsonld.parsed(payloads[url])
    except (KeyError, ValueError, RecursionError):
        return None


def _str(data: Any, *path: str) -> str:
    for key in path:
        data = data.get(key) if isinstance(data, dict) else None
    return data if isinstance(data, str) else ""


def _external(link: str) -> str:
    link = escape_attr(link)
    return f'<p><a href="{link}" target="_blank">{link}</a></p>'


def _thin(e: Extract | None) -> bool:
    return e is None or count_words_html(e.content) < 10


# -- BBCode and Substack notes (before the other sites) ----------------

_BB_TAGS = {"p": "p", "b": "strong", "i": "em", "u": "u", "h1": "h1", "h2": "h2", "h3": "h3", "list": "ul", "olist": "ol"}


def _safe_url(url: str) -> bool:
    return trim(url).lower().startswith(("http://", "https://", "/"))


def bbcode_to_html(source: str) -> str:
    out = source.replace("\n", "<br>").replace("[*]", "<li>")
    for tag, name in _BB_TAGS.items():
        out = out.replace(f"[{tag}]", f"<{name}>").replace(f"[/{tag}]", f"</{name}>")
    out = re.sub(r'\[url="?([^"\]]+)"?\](.*?)\[/url\]', lambda m: f'<a href="{escape_attr(m[1])}">{html_escape(m[2])}</a>' if _safe_url(m[1]) else html_escape(m[2]), out)
    out = re.sub(r'\[previewyoutube="?([^;"\]]+)[^"]*"?\]\[/previewyoutube\]', r'<iframe src="https://www.youtube.com/embed/\1"></iframe>', out)
    return re.sub(r"\[img\](.*?)\[/img\]", lambda m: f'<img src="{escape_attr(m[1])}">' if _safe_url(m[1]) else html_escape(m[0]), out)


def _first_item(doc: Node, name: str) -> dict:
    try:
        data = jsonld.parsed(_attr(doc, f"div[{name}]", name))
    except (ValueError, RecursionError):
        return {}
    return data[0] if isinstance(data, list) and data and isinstance(data[0], dict) else {}


def bbcode(doc: Node) -> Extract | None:
    event = _first_item(doc, "data-partnereventstore")
    body = event.get("announcement_body", {}).get("body") if isinstance(event.get("announcement_body"), dict) else None
    if not isinstance(body, str):
        return None
    return Extract(bbcode_to_html(body), _str(event, "event_name") or None, _str(_first_item(doc, "data-groupvanityinfo"), "group_name") or None)


def _prefixed(root: Node, prefix: str) -> list[Node]:
    return [n for n in root.elements() if any(c.startswith(prefix) for c in n.classes)]


def substack(doc: Node, url: str | None) -> Extract | None:
    """A note: its text, and its image if a grid of images stands beside it."""
    url = url or ""
    bodies = _prefixed(doc, "feedCommentBody-")
    if not ("substack.com" in url or _meta(doc, "og:site_name") == "Substack") or not ("/note/" in url or bodies):
        return None
    title, image, about = (_meta(doc, f"og:{x}") for x in ("title", "image", "description"))
    unit = _prefixed(doc, "feedPermalinkUnit-")[:1] if "/note/" in url else []
    inside = _prefixed(unit[0], "feedCommentBody-") if unit else []
    if inside:
        body, grid = inside[0], True
    elif bodies:
        body = next((b for b in bodies if trim(b.text()).startswith(about[:60])), bodies[0]) if about is not None else bodies[0]
        grid = len(bodies) == 1
    else:
        return None
    prose = next((n for n in select(doc, ".ProseMirror.FeedProseMirror") if n is body or n.inside(body)), None)
    content = inner_html(prose) if prose is not None else ""
    around = [a for a in (body.parent_element, body.parent_element.parent_element if body.parent_element else None) if a is not None]
    beside = any(c.startswith("imageGrid-") for a in around for n in a.child_elements() for c in n.classes)
    if grid and beside and image is not None:
        content += f'<img src="{escape_attr(image)}">'
    if not trim(content):
        return None
    return Extract(content, title, title.split(" (@")[0] if title is not None else None, "Substack", image=image)


# -- GitHub ------------------------------------------------------------

_API = "https://api.github.com/repos"
_BODY = '[data-testid="markdown-body"]'


def _github_title(doc: Node) -> str:
    title = _text(doc, "title")
    before, found, after = title.rpartition(" · ")
    return before if found and "/" in after else title


def _link_name(root: Node, selectors: tuple[str, ...], with_text: bool = False) -> str:
    for s in selectors:
        n = select_one(root, s)
        if n is None:
            continue
        if with_text and trim(n.text()):
            return trim(n.text())
        name = n.get("href")
        name = name.removeprefix("https://github.com/") if with_text and name.startswith("https://github.com/") else name.removeprefix("/")
        if name:
            return name
    return ""


def _github_issue(doc: Node, replies: bool) -> Extract:
    holder = select_one(doc, '[data-testid="issue-viewer-issue-container"]')
    author = _link_name(holder, ('[data-testid="issue-body-header-author"]', 'a[data-testid="avatar-link"]'), True) if holder is not None else ""
    body = _html(doc, f'[data-testid="issue-body-viewer"] {_BODY}') if holder is not None else ""
    comments = []
    for entry in select(doc, "[data-wrapper-timeline-id]") if replies else ():
        entry = select_one(entry, ".react-issue-comment") or entry
        if content := _html(entry, _BODY):
            by = _link_name(entry, ('[data-testid="avatar-link"]', 'a[href^="/"][data-hovercard-url]')) or "Unknown"
            comments.append(Comment(by, _day(_attr(entry, "relative-time", "datetime")), content))
    return Extract(post_html("github", body, comments), _github_title(doc), author or None, "GitHub")


def _github_pull(doc: Node, replies: bool) -> Extract:
    holder = select_one(doc, '[id^="pullrequest-"]')
    css = ".comment-body.markdown-body"
    comments = []
    for entry in select(doc, ".timeline-comment, .review-comment") if replies else ():
        if holder is not None and (entry is holder or entry.inside(holder)):
            continue
        if content := _html(entry, css):
            comments.append(Comment(_text(entry, ".author"), _day(_attr(entry, "relative-time", "datetime")), content))
    author = _text(holder, ".author") if holder is not None else ""
    return Extract(post_html("github", _html(holder if holder is not None else doc, css), comments), _github_title(doc), author or None, "GitHub")


#: Fixed value: so many pages of an API's answers are read.
API_PAGES = 10


def _pages(payloads: Payloads, url: str) -> list[dict]:
    out: list[dict] = []
    for page in range(1, API_PAGES + 1):
        rows = _load(payloads, f"{url}?per_page=100&page={page}")
        rows = rows if isinstance(rows, list) else []
        out += [r for r in rows if isinstance(r, dict)]
        if len(rows) < 100:
            break
    return out


def _api_comments(rows: list[dict], when: str = "created_at", with_path: bool = False) -> list[Comment]:
    out = []
    for r in rows:
        if trim(_str(r, "body")):
            path = f"<p><code>{html_escape(_str(r, 'path'))}</code></p>\n" if with_path and _str(r, "path") else ""
            login = r.get("user", {}).get("login") if isinstance(r.get("user"), dict) else None
            out.append(Comment(login if isinstance(login, str) else "Unknown", _day(r.get(when)), path + markdown_to_html(_str(r, "body"))))
    return out


def _github_api(url: str, payloads: Payloads, replies: bool) -> Extract | None:
    m = re.search(r"github\.com/([^/]+)/([^/]+)/(issues|pull)/(\d+)", url)
    if not m:
        return None
    repo, pull = f"{_API}/{m[1]}/{m[2]}", m[3] == "pull"
    item = _load(payloads, f"{repo}/{'pulls' if pull else 'issues'}/{m[4]}")
    if not isinstance(item, dict):
        return None
    labels = [_str(x, "name") for x in item.get("labels") or () if _str(x, "name")]
    status = ("merged" if item.get("merged") is True else _str(item, "state")) if pull else ""
    facts = (("Status", status), ("Labels", ", ".join(labels)), ("Milestone", _str(item, "milestone", "title")))
    head = "".join(f"<p><strong>{k}:</strong> {html_escape(v)}</p>\n" for k, v in facts if v)
    parts = []
    if replies:
        parts.append(comment_tree(_api_comments(_pages(payloads, f"{repo}/issues/{m[4]}/comments"))))
        if pull:
            reviews = _api_comments(_pages(payloads, f"{repo}/pulls/{m[4]}/reviews"), "submitted_at")
            parts.append(comment_tree(reviews + _api_comments(_pages(payloads, f"{repo}/pulls/{m[4]}/comments"), with_path=True)))
    content = post_html("github", head + markdown_to_html(_str(item, "body")), "\n".join(p for p in parts if p))
    return Extract(content, _str(item, "title") or None, _str(item, "user", "login") or None, "GitHub", _day(_str(item, "created_at")) or None)


def github(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    url = url or ""
    ours = "github.com/" in url or _has(doc, 'meta[name="expected-hostname"][content="github.com"]', 'meta[name="octolytics-url"]', 'meta[name="github-keyboard-shortcuts"]')
    pull = "/pull/" in url or _has(doc, ".pull-discussion-timeline", ".discussion-timeline", ".gh-header-title")
    issue = "/issues/" in url or _has(doc, '[data-testid="issue-metadata-sticky"]', '[data-testid="issue-title"]')
    if not ours or not (pull or issue):
        return None
    found = _github_pull(doc, replies) if pull else _github_issue(doc, replies)
    return (_github_api(url, payloads, replies) if _thin(found) else None) or found


# -- Reddit ------------------------------------------------------------


def _old_reddit(holder: Node, depth: int = 0) -> list[Comment]:
    out = []
    for n in holder.child_elements():
        if "thing" not in n.get("class") or "comment" not in n.get("class"):
            continue
        body, link = _html(n, ".usertext-body .md"), n.get("data-permalink")
        if body:
            out.append(Comment(n.get("data-author"), _day(_attr(n, "time[datetime]", "datetime")), body, depth, _text(n, ".score.unvoted") or None, f"https://reddit.com{link}" if link else None))
        below = select_one(n, ".child > .sitetable")
        if below is not None:
            out += _old_reddit(below, depth + 1)
    return out


def reddit(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    m = re.search(r"/r/([^/]+)", url or "")
    sub = m[1] if m else ""
    old, new = select_one(doc, ".thing.link"), select_one(doc, "shreddit-post")
    if old is not None:
        area = select_one(doc, ".commentarea .sitetable") if replies else None
        content = post_html("reddit", _html(old, ".usertext-body .md"), _old_reddit(area) if area is not None else [])
        return Extract(content, _text(old, "a.title"), old.get("data-author") or None, f"r/{old.attrs.get('data-subreddit', sub)}")
    if new is None:
        return None
    comments = []
    for n in select(doc, "shreddit-comment") if replies else ():
        if body := _html(n, '[slot="comment"]'):
            score, link = n.get("score"), n.get("permalink")
            comments.append(Comment(n.get("author"), "", body, _int(n.get("depth")), f"{score} points" if score else None, f"https://reddit.com{link}" if link else None))
    return Extract(post_html("reddit", _html(new, '[slot="text-body"]'), comments), _text(doc, "h1"), new.get("author") or None, f"r/{sub}")


# -- Hacker News -------------------------------------------------------

_HN_ITEM, _HN_API = "https://news.ycombinator.com/item?id=", "https://hacker-news.firebaseio.com/v0/item"
#: How deep and how many comments are read from the API.
HN_DEPTH, HN_COMMENTS = 3, 20


def unix_day(seconds: Any) -> str:
    if not isinstance(seconds, int) or isinstance(seconds, bool) or abs(seconds) > 253_402_300_799:  # the year 9999 ends
        return ""
    return (datetime(1970, 1, 1) + timedelta(seconds=max(seconds, -62_135_596_800))).strftime("%Y-%m-%d")


def _hn_comments(doc: Node) -> list[Comment]:
    out, seen = [], set()
    for row in select(doc, "tr.comtr"):
        name, body = row.attrs.get("id"), _html(row, ".commtext")
        if name is None or name in seen:
            continue
        seen.add(name)
        if body:
            out.append(Comment(_text(row, ".hnuser", "[deleted]"), _day(_attr(row, ".age", "title")), body, _int(_attr(row, ".ind img", "width")) // 40, _text(row, ".score") or None, _HN_ITEM + name))
    return out


def _hn_title(author: str, content: str) -> str:
    return f"Comment by {author}: {_cut(trim(strip_html_tags(content)))}"


def _hn_page(doc: Node, replies: bool) -> Extract | None:
    item = select_one(doc, ".fatitem")
    if item is None:
        return None
    comments = _hn_comments(doc) if replies else []
    if _has(item, ".onstory") and not _has(item, ".titleline"):
        row = select_one(item, "tr.athing")
        body = _html(row, ".commtext") if row is not None else ""
        if not body:
            return None
        main = Comment(_text(row, ".hnuser"), _day(_attr(row, ".age", "title")), body)
        return Extract(post_html("hackernews", comment_html(main), comments), _hn_title(main.author, body), main.author or None, "Hacker News")
    link, text = select_one(item, ".titleline a"), select_one(item, ".toptext")
    post = _external(link.attrs["href"]) if link is not None and "href" in link.attrs else ""
    post += f'<div class="post-text">{trim(inner_html(text))}</div>' if text is not None else ""
    return Extract(post_html("hackernews", post, comments), _text(item, ".titleline"), _text(item, ".hnuser") or None, "Hacker News", _day(_attr(item, ".age", "title")) or None)


def _hn_kids(parent: dict, payloads: Payloads, out: list[Comment], depth: int = 0) -> list[Comment]:
    for kid in parent.get("kids") or () if depth < HN_DEPTH else ():
        if len(out) >= HN_COMMENTS:
            break
        item = _load(payloads, f"{_HN_API}/{kid}.json")
        if isinstance(item, dict) and item.get("deleted") is not True and trim(_str(item, "text")):
            out.append(Comment(_str(item, "by"), unix_day(item.get("time")), _str(item, "text"), depth, None, f"{_HN_ITEM}{kid}"))
            _hn_kids(item, payloads, out, depth + 1)
    return out


def _hn_api(url: str, payloads: Payloads, replies: bool) -> Extract | None:
    m = re.search(r"id=(\d+)(?:&|\Z)", url)
    item = _load(payloads, f"{_HN_API}/{m[1]}.json") if m else None
    if not isinstance(item, dict):
        return None
    comments = _hn_kids(item, payloads, []) if replies else []
    author, text = _str(item, "by"), _str(item, "text")
    if item.get("type") in ("story", "job", "poll"):
        post = (_external(item["url"]) if isinstance(item.get("url"), str) else "") + (f'<div class="post-text">{text}</div>' if isinstance(item.get("text"), str) else "")
        return Extract(post_html("hackernews", post, comments), _str(item, "title") or None, author or None, "Hacker News", unix_day(item.get("time")) or None)
    if item.get("type") == "comment" and trim(text):
        main = Comment(author, unix_day(item.get("time")), text)
        return Extract(post_html("hackernews", comment_html(main), comments), _hn_title(author, text), author or None, "Hacker News")
    return None


def hackernews(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    if "news.ycombinator.com" not in (url or "") and not _has(doc, ".fatitem"):
        return None
    found = _hn_page(doc, replies)
    return (_hn_api(url or "", payloads, replies) if _thin(found) else None) or found


# -- Stack Exchange ----------------------------------------------------

#: Sites with names of their own.
SE_SITES = {"stackoverflow.com": ("stackoverflow", "Stack Overflow"), "serverfault.com": ("serverfault", "Server Fault"), "superuser.com": ("superuser", "Super User"), "askubuntu.com": ("askubuntu", "Ask Ubuntu"), "mathoverflow.net": ("mathoverflow", "MathOverflow")}
_SE_API = "https://api.stackexchange.com/2.3"


def se_site(url: str) -> tuple[str, str] | None:
    """Name in the API and name to show."""
    m = re.match(r"https?://([^/]*)", url)
    for domain, names in SE_SITES.items() if m else ():
        if domain in m[1]:
            return names
    if m and m[1].endswith(".stackexchange.com"):
        name = m[1].removesuffix(".stackexchange.com")
        return name, f"{name[:1].upper()}{name[1:]} Stack Exchange"
    return None


def _last_text(root: Node, selector: str) -> str:
    row = select(root, selector)
    return trim(row[-1].text()) if row else ""


def stack_exchange(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    url = url or ""
    if not any(f"{d}/questions/" in url for d in (*SE_SITES, ".stackexchange.com")):
        return None
    names = se_site(url)
    found = None
    if body := _html(doc, ".question .js-post-body"):
        answers = []
        for n in select(doc, ".answer") if replies else ():
            if own := _html(n, ".js-post-body"):
                score = f"{_text(n, '.js-vote-count', '0')} votes" + ", accepted" * ("accepted-answer" in n.classes)
                answers.append(Comment(_last_text(n, ".user-details a"), "", own, 0, score))
        found = Extract(post_html("stackoverflow", body, answers), _text(doc, "#question-header h1") or None, _last_text(doc, ".question .user-details a") or None, names[1] if names else "Stack Overflow")
    return (_se_api(url, names, payloads, replies) if _thin(found) else None) or found


def _se_api(url: str, names: tuple[str, str] | None, payloads: Payloads, replies: bool) -> Extract | None:
    m = re.search(r"/questions/(\d+)(?:/|\Z)", url)
    if not m or names is None:
        return None
    ask = f"{_SE_API}/questions/{m[1]}"
    items = (_load(payloads, f"{ask}?site={names[0]}&filter=withbody&order=desc&sort=activity") or {}).get("items") or [{}]
    if not trim(_str(items[0], "body")):
        return None
    rows = (_load(payloads, f"{ask}/answers?site={names[0]}&filter=withbody&order=desc&sort=votes&pagesize=20") or {}).get("items") or [] if replies else []
    answers = [Comment(_str(r, "owner", "display_name"), "", _str(r, "body"), 0, f"{r.get('score') or 0} votes" + ", accepted" * (r.get("is_accepted") is True)) for r in rows if trim(_str(r, "body"))]
    content = post_html("stackoverflow", f'<div class="post-text">{_str(items[0], "body")}</div>', answers)
    return Extract(content, _str(items[0], "title") or None, _str(items[0], "owner", "display_name") or None, names[1])


# -- Lobsters ----------------------------------------------------------


def _lobsters_depth(n: Node) -> int:
    tree = next((a for a in (n, *n.ancestors()) if "comments_subtree" in a.classes), None)
    m = re.search(r"(?:\A|;)\s*margin-left\s*:\s*([\d.]+)\s*px\s*(?:;|\Z)", tree.get("style")) if tree is not None else None
    return int(float(m[1]) + 0.5) // 18 if m else 0


def lobsters(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    m = re.search(r"lobste\.rs/s/([^/]*)", url or "")
    if not m:
        return None
    found = None
    link, body = _attr(doc, ".u-repost-of", "href"), _html(doc, ".story_text")
    if link or body:
        comments = []
        for n in select(doc, ".comment_text") if replies else ():
            holder = next((a for a in (n, *n.ancestors()) if "comment" in a.classes), None)
            if own := trim(inner_html(n)):
                meta = (_text(holder, ".comment_author a"), _lobsters_depth(holder), _text(holder, ".comment_score")) if holder is not None else ("", 0, "")
                comments.append(Comment(meta[0], "", own, meta[1], meta[2] or None))
        post = (_external(link) if link else "") + (f'<div class="post-text">{body}</div>' if body else "")
        found = Extract(post_html("lobsters", post, comments), _text(doc, ".u-repost-of") or None, None, "Lobsters")
    return (_lobsters_api(m[1], payloads, replies) if _thin(found) else None) or found


def _lobsters_api(name: str, payloads: Payloads, replies: bool) -> Extract | None:
    item = _load(payloads, f"https://lobste.rs/s/{name}.json") if name else None
    link, about = _str(item, "url"), _str(item, "description")
    if not link and not trim(about):
        return None
    rows = [r for r in item.get("comments") or () if trim(_str(r, "comment"))] if replies else []
    comments = [Comment(_str(r, "commenting_user", "username"), "", _str(r, "comment"), r.get("depth") or 0, f"{r.get('score') or 0} points") for r in rows]
    post = (_external(link) if link else "") + (f'<div class="post-text">{about}</div>' if trim(about) else "")
    day = _day(item["created_at"]) if isinstance(item.get("created_at"), str) else None
    return Extract(post_html("lobsters", post, comments), _str(item, "title") or None, _str(item, "submitter_user", "username") or None, "Lobsters", day)


# -- X -----------------------------------------------------------------


def percent_encode(s: str) -> str:
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or chr(b) in "-_.~" else f"%{b:02X}" for b in s.encode())


def _x_handle(url: str) -> str:
    m = re.search(r"/([a-zA-Z0-9_]{1,15})/(?:article|status)/\d+", url)
    return f"@{m[1]}" if m else ""


def _x_author(doc: Node, url: str) -> str:
    holder = select_one(doc, '[itemprop="author"]')
    name, handle = (_attr(holder, f'meta[itemprop="{x}"]', "content") if holder is not None else "" for x in ("name", "additionalName"))
    return f"{name} (@{handle})" if name and handle else name or handle or _x_handle(url)


def _x_image(doc: Node, body: Node) -> str:
    view = select_one(doc, '[data-testid="twitterArticleReadView"]')
    image = select_one(view, '[data-testid="tweetPhoto"] img') if view is not None else None
    if image is None or image.inside(body) or "src" not in image.attrs:
        return ""
    src = image.attrs["src"]
    src = re.sub(r"&name=\w+", "&name=large", src, count=1) if "&name=" in src else f"{src}{'&' if '?' in src else '?'}name=large"
    return f'<img src="{escape_attr(src)}" alt="{escape_attr(image.attrs.get("alt", "Image"))}">'


def x_post(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    url = url or ""
    body = select_one(doc, '[data-testid="twitterArticleRichTextView"]') if "x.com/" in url or "twitter.com/" in url else None
    if body is not None:
        content = f'<article class="x-article">{_x_image(doc, body)}{trim(inner_html(body))}</article>'
        return Extract(content, _text(doc, '[data-testid="twitter-article-title"]', "Untitled X Article"), _x_author(doc, url) or None, "X (Twitter)")
    if not re.search(r"(?:x\.com|twitter\.com)/[a-zA-Z0-9_]{1,15}/status/\d+", url):
        return None
    card = _load(payloads, f"https://publish.twitter.com/oembed?url={percent_encode(url)}")
    if trim(_str(card, "html")):
        return Extract(_str(card, "html"), None, _str(card, "author_name") or None, "X (Twitter)")
    title = _meta(doc, "og:title")
    if title is None:
        return None
    said = re.search(r'(?:\(\d+\)\s+)?[^:]+\s+on\s+X:\s*["“”](.+?)["“”]', title)
    by = re.search(r"(?:\(\d+\)\s+)?(.+?)\s+on\s+X:", _text(doc, "title"))
    return Extract("", said[1] if said else title.removesuffix(" / X"), (by[1] if by else _x_handle(url)) or None, "X (Twitter)")


# -- C2 wiki -----------------------------------------------------------


def wiki_title(word: str) -> str:
    return re.sub(r"(?<=[^\W\d_])(?=[^\W\d_])", lambda m: " " if m.string[m.start() - 1].islower() and m.string[m.start()].isupper() else "", word)


def _wiki_word(m: re.Match) -> str:
    word = m[0]
    linked = len(word.encode()) >= 3 and word[0].isupper() and sum(c.isupper() for c in word) >= 2 and any(c.islower() for c in word)
    return f'<a href="https://wiki.c2.com/?{word}">{wiki_title(word)}</a>' if linked else word


def wiki_to_html(text: str) -> str:
    paragraphs = re.split(r"\n(?:\s*\n)+", "\n".join(trim(x) for x in text.splitlines()))
    out = []
    for p in paragraphs:
        lines = []
        for line in filter(None, p.split("\n")):
            parts = line.split("''")
            marked = "".join(x + (("</em>" if k % 2 else "<em>") if k < len(parts) - 1 else "") for k, x in enumerate(parts)) + "</em>" * (len(parts) % 2 == 0)
            lines.append(re.sub(r"[^\W_]+", _wiki_word, marked))
        if lines:
            out.append(f"<p>{' '.join(lines)}</p>\n")
    return "".join(out)


def c2_wiki(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    if "wiki.c2.com" not in (url or ""):
        return None
    m = re.search(r"\A[^?]*\?([^=]+)\Z", url)
    name = m[1] if m else None
    page = select_one(doc, ".page[data-title]")
    if page is not None and trim(inner_html(page)):
        title = wiki_title(page.get("data-title")) or (wiki_title(name) if name else None)
        return Extract(inner_html(page), title, None, "C2 Wiki")
    item = _load(payloads, f"https://c2.com/wiki/remodel/pages/{name}") if name else None
    if not trim(_str(item, "text")):
        return None
    return Extract(wiki_to_html(_str(item, "text")), wiki_title(name), None, "C2 Wiki", _str(item, "date") or None)


# -- chats -------------------------------------------------------------

Message = tuple[str, str, str]  # author, role, HTML


def _turns(nodes: list[tuple[Node | None, bool]], name: str) -> list[Message]:
    rows = ((("You", "user") if user else (name, "assistant"), trim(inner_html(n)) if n is not None else "") for n, user in nodes)
    return [(*who, html) for who, html in rows if html]


def _chatgpt(doc: Node) -> list[Message]:
    turns = select(doc, 'article[data-testid^="conversation-turn-"]')
    if not turns:
        return _turns([(n, k % 2 == 0) for k, n in enumerate(select(doc, ".group"))], "ChatGPT")
    return _turns([(select_one(n, ".markdown-body, .markdown") or select_one(n, ".prose, .text-message"), "you" in _text(n, "h5.sr-only, h6.sr-only").lower()) for n in turns], "ChatGPT")


def _claude(doc: Node) -> list[Message]:
    user = '[data-testid="user-message"]'
    mine = {id(n) for n in select(doc, user)}
    return _turns([(n, id(n) in mine) for n in select(doc, f'{user}, [data-testid="assistant-message"], div.font-claude-response')], "Claude")


def _gemini(doc: Node) -> list[Message]:
    rows = select(doc, "div.conversation-container")
    if rows:
        return _turns([(select_one(n, tag), tag == "user-query") for n in rows for tag in ("user-query", "model-response")], "Gemini")
    pairs = zip(select(doc, ".query-content"), select(doc, ".response-content"))
    return _turns([x for q, r in pairs for x in ((q, True), (r, False))], "Gemini")


def _grok(doc: Node) -> list[Message]:
    rows = select(doc, ".relative.group.flex.flex-col.justify-center.w-full")
    return _turns([(n, "items-end" in n.get("class")) for n in rows if "items-end" in n.get("class") or "items-start" in n.get("class")], "Grok")


#: Name, words of addresses, selectors that give the site away, reader, endings of titles.
CHATS: tuple[tuple[str, tuple[str, ...], tuple[str, ...], Callable[[Node], list[Message]], tuple[str, ...]], ...] = (
    ("ChatGPT", ("chatgpt.com", "chat.openai.com"), ('article[data-testid^="conversation-turn-"]',), _chatgpt, (" - ChatGPT", " | ChatGPT")),
    ("Claude", ("claude.ai",), ('[data-testid="user-message"]', "div.font-claude-response"), _claude, (" - Claude", " | Claude")),
    ("Gemini", ("gemini.google.com",), ("div.conversation-container", "user-query"), _gemini, (" - Gemini", " - Google Gemini")),
    ("Grok", ("grok.com", "x.com/i/grok"), (), _grok, (" - Grok", " | Grok")),
)


def chat_html(messages: list[Message]) -> str:
    rows = [f'<div class="message message-{role}" data-role="{role}"><div class="message-header"><strong>{html_escape(author)}</strong></div><div class="message-content">{html}</div></div>' for author, role, html in messages]
    return f'<div class="conversation">{"".join(rows)}</div>'


def chat(doc: Node, url: str | None, replies: bool, payloads: Payloads) -> Extract | None:
    url = url or ""
    for name, addresses, marks, read, endings in CHATS:
        grok = name == "Grok" and "grok" in url and _has(doc, "div.items-end") and _has(doc, "div.items-start")
        if any(a in url for a in addresses) or _has(doc, *marks) or grok:
            break
    else:
        return None
    messages = read(doc)
    if not messages:
        return None
    title = _text(doc, "title")
    title = next((title.removesuffix(e) for e in endings if title.endswith(e)), title)
    if not title or title == name:
        first = next((m for m in messages if m[1] == "user"), None)
        title = _cut(trim(strip_html_tags(first[2]))) if first else f"{name} Conversation"
    return Extract(chat_html(messages), title, None, name)


#: In the order in which they are tried.
SITES: tuple[tuple[str, Callable[[Node, str | None, bool, Payloads], Extract | None]], ...] = (
    ("github", github),
    ("reddit", reddit),
    ("hackernews", hackernews),
    ("stackoverflow", stack_exchange),
    ("lobsters", lobsters),
    ("twitter", x_post),
    ("c2wiki", c2_wiki),
    ("conversation", chat),
)


def site_extract(doc: Node, url: str | None, replies: bool = True, payloads: Payloads | None = None) -> tuple[str, Extract] | None:
    found = ((name, read(doc, url, replies, payloads or {})) for name, read in SITES)
    return next(((name, e) for name, e in found if e is not None), None)


def api_urls(url: str | None) -> list[str]:
    """API addresses that may complete a page of this address; what is nested (comments of comments) comes after their answers."""
    url = url or ""
    out: list[str] = []
    if m := re.search(r"github\.com/([^/]+)/([^/]+)/(issues|pull)/(\d+)", url):
        repo, page = f"{_API}/{m[1]}/{m[2]}", "?per_page=100&page=1"
        out += [f"{repo}/{'pulls' if m[3] == 'pull' else 'issues'}/{m[4]}", f"{repo}/issues/{m[4]}/comments{page}"]
        out += [f"{repo}/pulls/{m[4]}/{x}{page}" for x in ("reviews", "comments")] if m[3] == "pull" else []
    if "news.ycombinator.com" in url and (m := re.search(r"id=(\d+)", url)):
        out.append(f"{_HN_API}/{m[1]}.json")
    if (names := se_site(url)) and (m := re.search(r"/questions/(\d+)(?:/|\Z)", url)):
        ask = f"{_SE_API}/questions/{m[1]}"
        out += [f"{ask}?site={names[0]}&filter=withbody&order=desc&sort=activity", f"{ask}/answers?site={names[0]}&filter=withbody&order=desc&sort=votes&pagesize=20"]
    if m := re.search(r"lobste\.rs/s/([^/]+)", url):
        out.append(f"https://lobste.rs/s/{m[1]}.json")
    if re.search(r"(?:x\.com|twitter\.com)/[a-zA-Z0-9_]{1,15}/status/\d+", url):
        out.append(f"https://publish.twitter.com/oembed?url={percent_encode(url)}")
    if "wiki.c2.com" in url and (m := re.search(r"\A[^?]*\?([^=]+)\Z", url)):
        out.append(f"https://c2.com/wiki/remodel/pages/{m[1]}")
    return out
