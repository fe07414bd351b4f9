"""Word lists, patterns and thresholds of the call analytics.

Fixed values: results depend on every entry, and ties go to the entry that stands first.
"""

from __future__ import annotations

CLASSIFICATION = {
    "business-meeting": ["agenda", "action item", "follow up", "next steps", "let's discuss", "any questions", "moving on", "take away", "meeting", "quarterly", "review", "update", "status"],
    "sales-call": ["pricing", "proposal", "contract", "deal", "close", "discount", "competitor", "budget", "decision maker", "timeline", "objection", "demo", "pilot", "roi", "implementation"],
    "discovery-call": ["pain point", "challenge", "currently using", "workflow", "frustrat", "problem", "how do you", "what happens when", "walk me through", "tell me about", "biggest challenge"],
    "standup": ["standup", "blocker", "yesterday", "today I", "sprint", "pull request", "pr review", "blocked on"],
    "interview-behavioral": ["interview", "behavioral", "tell me about a time", "describe a situation", "competency", "star", "give me an example", "candidate", "hiring"],
    "interview-technical": ["interview", "technical", "coding", "algorithm", "system design", "whiteboard", "data structure", "complexity", "candidate"],
    "support-escalation": ["support", "ticket", "issue", "escalat", "resolution", "workaround", "outage", "incident", "sla", "customer complaint"],
    "qbr": ["quarterly business review", "qbr", "renewal", "adoption", "usage", "health score", "churn", "expansion", "success metric", "roi"],
    "pmf-call": ["product", "feature", "workflow", "use case", "adoption", "can't live without", "disappointed", "alternative", "switching", "recommend", "love", "critical", "essential"],
    "investor-pitch": ["pitch", "investor", "raise", "funding", "valuation", "term sheet", "cap table", "runway", "burn rate", "traction", "series"],
    "one-on-one": ["one on one", "1:1", "career", "development", "feedback", "how are you doing", "blockers", "growth", "promotion"],
    "cofounder-alignment": ["cofounder", "co-founder", "vision", "equity split", "roles", "alignment", "direction", "company", "strategy"],
    "advisory-call": ["advisor", "mentor", "advice", "introduce you to", "in my experience", "have you considered", "recommendation", "guidance"],
    "board-meeting": ["board", "directors", "governance", "fiduciary", "resolution", "quorum", "minutes", "vote", "motion"],
    "customer-onboarding": ["onboarding", "setup", "getting started", "welcome", "first steps", "training", "walkthrough", "configuration"],
    "sprint-retro": ["retro", "retrospective", "went well", "improve", "start doing", "stop doing", "keep doing", "action item"],
    "postmortem": ["postmortem", "post-mortem", "incident", "root cause", "outage", "severity", "timeline", "contributing factor", "prevention"],
    "podcast": ["podcast", "episode", "listeners", "audience", "show notes", "guest", "host", "subscribe"],
    "classroom": ["class", "student", "lesson", "homework", "assignment", "curriculum", "exam", "quiz", "lecture"],
    "coaching-session": ["coaching", "coach", "goal", "accountability", "growth", "self-awareness", "commitment", "breakthrough"],
    "performance-review": ["performance", "review", "rating", "objectives", "kpi", "improvement plan", "feedback", "evaluation"],
    "churn-save": ["cancel", "churn", "leaving", "not renewing", "downgrade", "save", "retention", "win back"],
    "vendor-evaluation": ["vendor", "evaluation", "rfp", "comparison", "demo", "requirement", "pricing", "procurement"],
    "voice-memo": [],
}

ACTIONS = [
    r"(?i)\b(?:action item|todo|to do|task)\b[:\s]*(.+)",
    r"(?i)\b(?:will|going to|need to|should|must)\s+(.+?)(?:\.|$)",
    r"(?i)\b(?:follow up|follow-up)\b[:\s]*(.+?)(?:\.|$)",
    r"(?i)\b(?:let's|let us)\s+(.+?)(?:\.|$)",
]
DECISIONS = [
    r"(?i)\b(?:decided|agreed|decision is|we'll go with|the plan is)\b[:\s]*(.+?)(?:\.|$)",
    r"(?i)\b(?:we're going to|we are going to|consensus is)\b[:\s]*(.+?)(?:\.|$)",
    r"(?i)\b(?:approved|confirmed|finalized)\b[:\s]*(.+?)(?:\.|$)",
]
SUMMARY_TRANSITIONS = ["moving on", "next topic", "let's talk about", "now regarding", "turning to", "let's move on", "another thing"]
TOPIC_TRANSITIONS = ["moving on", "next topic", "let's talk about", "now regarding", "turning to", "let's move on", "another thing", "next up", "let's discuss", "shifting to", "on the topic of"]

SALES = {
    "ownership language": ["when we implement", "our team would", "we could use", "we'd want"],
    "implementation interest": ["how would we integrate", "what's the setup", "onboarding process"],
    "timeline specificity": ["by q", "by end of", "before next", "this quarter"],
    "budget discussion": ["what's the pricing", "what does it cost", "within our budget"],
}
SALES_RISK = {
    "stall language": ["need to think about", "get back to you", "not sure yet", "let me check"],
    "vague next steps": ["i'll follow up", "let's touch base", "we'll be in touch"],
    "missing authority": ["need to check with", "have to ask my", "not my decision"],
    "price objection": ["too expensive", "over budget", "can't afford", "cheaper alternative"],
}
PAINS = ["frustrating", "painful", "annoying", "waste of time", "takes too long", "biggest challenge", "struggle with", "problem is", "issue is", "can't figure out", "doesn't work", "breaks when", "hate"]
COMMITMENTS = {
    "time": ["let's schedule", "happy to do a follow-up", "set up a demo", "meet again"],
    "reputation": ["introduce you to", "mention it to", "bring in my", "connect you with", "email an intro", "intro to"],
    "money": ["what's the pricing", "send me a proposal", "budget for this", "willing to pay"],
}
HYPOTHETICALS = ["would you", "do you think", "how much would you pay", "would you use", "would you buy", "would it be useful"]
PMF = {
    "dependency": ["can't live without", "critical", "essential", "rely on", "depend on", "couldn't go back", "need this"],
    "evangelism": ["told", "recommended", "showed", "referred", "mentioned it to", "our team loves", "everyone uses"],
    "workflow_depth": ["every day", "every morning", "every week", "part of our process", "built into", "integrated with", "workflow", "daily standup"],
    "switching_cost": ["built around", "integrated", "migrated", "customized", "trained the team", "can't imagine switching"],
    "wtp": ["worth the price", "great value", "roi", "saves us", "pay more for", "worth every penny", "budget"],
    "anti_pmf": ["nice to have", "also using", "alternative", "spreadsheet", "workaround", "not sure we need", "could live without", "haven't used it much", "forgot about"],
}
FEATURES = {
    "incremental": ["export", "filter", "sort", "integration", "api", "format", "customize", "theme", "shortcut", "bulk"],
    "fundamental": ["completely redesign", "doesn't work for", "missing core", "can't do basic", "need a different", "wrong approach"],
}
STAR = {
    "situation": ["when i was", "at my previous", "in my last role", "there was a time", "the context was"],
    "task": ["my responsibility", "i was tasked", "i needed to", "the goal was", "i was supposed to"],
    "action": ["i decided to", "i implemented", "i built", "i led", "i created", "what i did was", "i approached"],
    "result": ["the result was", "we achieved", "this led to", "the outcome", "we improved", "increased by", "decreased by", "saved"],
}
ISSUES = {
    "bug": ["bug", "broken", "doesn't work", "error", "crash", "not working", "failing"],
    "feature_request": ["would be nice", "feature", "could you add", "wish it had", "missing"],
    "billing": ["charge", "invoice", "billing", "refund", "payment", "subscription", "plan"],
    "how_to": ["how do i", "how can i", "where do i", "can't find", "help me", "tutorial"],
    "outage": ["down", "outage", "unavailable", "can't access", "service disruption", "503"],
}
SUPPORT = {
    "frustration": ["frustrated", "angry", "unacceptable", "ridiculous", "terrible", "worst", "furious"],
    "satisfaction": ["thank you", "that helps", "perfect", "great", "appreciate", "solved", "wonderful"],
    "empathy": ["i understand", "i'm sorry", "that must be", "let me help", "i appreciate your patience"],
    "resolution": ["resolved", "fixed", "solved", "working now", "that did it"],
    "escalation": ["escalate", "manager", "supervisor", "engineering team"],
}
QBR = {
    "expansion": ["more seats", "additional users", "another team", "expand", "upgrade", "enterprise plan", "premium", "add-on", "grow", "scale"],
    "churn": ["cancel", "downgrade", "not renewing", "looking at alternatives", "budget cuts", "considering other", "not sure we'll continue", "disappointed", "not getting value"],
    "positive": ["love", "great", "value", "roi", "successful", "adoption", "team loves", "can't imagine without", "essential"],
    "negative": ["frustrated", "issue", "problem", "complaint", "bug", "slow", "unreliable", "missing", "confusing"],
}
RELATIONSHIP = {
    "validation": ["i understand", "that makes sense", "i hear you", "you're right", "good point", "i see what you mean", "that's fair", "i agree", "thank you", "thanks", "appreciate"],
    "criticism": ["you always", "you never", "why can't you", "you should", "what's wrong with you"],
    "positive": ["love", "appreciate", "thank", "grateful", "wonderful", "amazing", "great", "proud", "happy", "glad", "enjoy"],
    "negative": ["annoying", "frustrated", "angry", "disappointed", "upset", "hate", "terrible", "awful", "stupid", "ridiculous"],
}
PITCH = {
    "interest_signals": ["tell me more", "how does", "what's the timeline", "send me", "data room", "introduce you to", "next steps", "follow up", "let me connect you", "term sheet", "due diligence"],
    "investor_concerns": ["worried about", "what if", "risk", "competition", "burn rate", "runway", "market size", "defensibility", "unit economics"],
}
RECRUITING = {
    "qualification_signals": ["years of experience", "background in", "worked with", "proficient", "certification", "degree", "skill", "expertise"],
    "red_flags": ["gap in resume", "short tenure", "fired", "let go", "conflict", "not a team player", "concerns about"],
    "compensation": ["salary", "compensation", "equity", "stock", "bonus", "benefits", "base pay", "total comp", "offer", "package"],
}
MANAGEMENT = {
    "career": ["career", "growth", "promotion", "development", "goals", "aspirations", "learning"],
    "status": ["update", "progress", "status", "working on", "completed", "shipped"],
    "blockers": ["blocked", "stuck", "need help", "waiting on", "dependency", "can't proceed"],
    "burnout_indicators": ["overwhelmed", "stressed", "too much", "exhausted", "burned out", "workload"],
    "alignment_signals": ["vision", "direction", "strategy", "priorities", "disagree", "aligned", "misaligned"],
    "advice_given": ["suggest", "recommend", "have you tried", "you should", "in my experience", "introduction"],
}
OPERATIONS = {
    "blockers_detected": ["blocked", "stuck", "waiting", "dependency", "can't", "blocker", "impediment"],
    "went_well": ["went well", "liked", "great", "good job", "proud", "success"],
    "to_improve": ["improve", "didn't go well", "frustrating", "should have", "next time"],
    "root_cause_signals": ["root cause", "because", "caused by", "due to", "contributing factor", "triggered by"],
    "blame_signals": ["fault", "blame", "who did", "responsible for breaking", "should have known"],
}
CUSTOMER = {
    "confusion_points": ["confused", "don't understand", "how do i", "where is", "can't find", "lost", "unclear"],
    "churn_signals": ["cancel", "leaving", "switching to", "not renewing", "too expensive", "doesn't meet", "competitor"],
    "milestones_detected": ["set up", "configured", "first", "launched", "went live", "onboarded", "trained"],
    "vendor_criteria": ["requirement", "feature comparison", "pricing", "vendor", "evaluate", "demo", "criteria"],
}
EDUCATION = {
    "comprehension_signals": ["understand", "makes sense", "got it", "clear", "i see"],
    "confusion_signals": ["confused", "don't get", "can you repeat", "what do you mean", "lost me"],
    "goal": ["goal", "objective", "want to achieve", "aim", "target"],
    "reality": ["current situation", "right now", "at the moment", "currently"],
    "options": ["could", "option", "alternative", "what if", "possibility"],
    "will": ["commit", "will do", "by next", "action", "plan to"],
}
THERAPY = {
    "coping_strategies": ["breathing", "mindfulness", "journal", "exercise", "meditation", "grounding", "self-care"],
    "emotions_mentioned": ["anxious", "depressed", "angry", "sad", "hopeful", "grateful", "calm", "overwhelmed"],
    "homework_signals": ["homework", "practice", "try this", "between sessions", "this week"],
}
