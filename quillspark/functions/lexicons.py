"""Fixed values of the measurements: word lists, patterns, thresholds, labels.

Patterns use only what Java and RE2 regular expressions both understand, so the
same string serves Spark and an SQL engine; a word character is written out.
"""

# The function-word list of the distance measure.
FUNCTION_WORDS = sorted(set(
    "the of and to a in that is was it for on are as with his they at be this from i you or had not but what "
    "all were we when your can said there use an each which she do how their if will up other about out many then them "
    "these so some her would make like him into time has look two more write go see number no way could people my than "
    "first water been call who down side now find any new work part take get place made live where after back little "
    "only round man year came show every good me give our under name very through just form much great think say help "
    "low line before turn cause same mean differ move right also around another come three word must because does even "
    "here old too may such still between should never while might shall upon whether toward against among nor yet either "
    "neither its their our your my whom whose itself himself herself themselves".split()
))

# Subordinators of the clause measures.
SUBORDINATORS = r"\b(?:because|although|though|while|whereas|since|if|unless|until|when|whenever|where|that|which|who|whom|whose|after|before|as|so that|in order)\b"

# The 36 surface features.  Basis: what text a pattern is counted
# on (pc: prose without parentheses; low: the same in lower case; p: prose;
# raw: the document); patterns of one feature are summed.
SHAPE = {
    "emdash": ("p", ["—"]),
    "semicolon": ("pc", [";"]),
    "comma_not": ("pc", [r",\s+not\s+"]),
    "rather_than": ("low", [r"\brather than\b"]),
    "not_but": ("low", [r"\bnot\b[^.,]{1,40}\bbut\b"]),
    "triadic": ("pc", [r"[^,.;:()]+,\s+[^,.;:()]+,\s+(?:and|or)\s+[^,.;:()]+"]),
    "compound_and": ("pc", [r",\s+and\s+"]),
    "appositive": ("pc", [r",\s+(?:the|a|an)\s+\w+(?:\s+\w+){0,3},"]),
    "what_cleft": ("pc", [r"\b[Ww]hat\b[^.,]{1,45}\bis\b", r"\b[Ii]t is\b[^.,]{1,45}\bthat\b"]),
    "abstract_subj": ("pc", [r"(?:^|\.\s+)The\s+[a-z]+\s+(?:is|was|are|has|lies|comes|turns)\b"]),
    "demonstr_abstract": ("low", [r"\b(?:this|that|these|those)\s+(?:failure|coupling|obstruction|tension|distinction|residue|question|problem|move|point|account|gap|regress|pattern|practice|claim|argument|view|reading)\b"]),
    "which_is_tail": ("low", [r",\s+which\s+(?:is|are|was|means|gives|makes|leaves|amounts)\b"]),
    "the_way_each": ("low", [r"\bthe way (?:each|in which|that)\b", r"\bthe (?:one|kind|sort|thing) (?:that|which)\b"]),
    "to_inf_purpose": ("low", [r",\s+(?:so as |in order )?to\s+\w+,"]),
    "intensifier": ("low", [r"\b(?:precisely|exactly|itself|the very|in fact|indeed|merely|simply)\b"]),
    "that_density": ("low", [r"\bthat\b"]),
    "first_person": ("low", [r"\b(?:we|our|us)\b"]),
    "meta_narration": ("low", [
        r"the (?:contribution|point|crux) is|(?:is|are) the (?:contribution|point|crux|upshot|lesson)\b"
        r"|\b(?:all|what) we claim\b|the contribution we claim"
        r"|what (?:this|the|our|the present) (?:paper|argument|account|reading|analysis) (?:adds|offers|does|claims|shows)"
        r"|what is new is|the key insight|turns out that|the gap (?:this|the) (?:paper|argument)"
        r"|the obvious (?:move|answer)|the (?:standard|common) (?:fix|approach) is"
        r"|status is modest|supplies no .{0,14}rigor|organizes the argument|earns its keep"
        r"|does analytic work|is a consistency (?:device|check)|whose status is"
        r"|rather than bury|read honestly|to be (?:honest|clear|precise|fair|blunt)\b"
        r"|holds? a line|in the foreground|keep\w* [^.,]{1,25} in (?:the foreground|view)"
        r"|belongs here|which is why it sits|sits here\b|deserves a \w+, not a|we are careful|with care, since"
        r"|\bwe (?:recast|carr(?:y|ies|ied)|adapt|build on|reframe|situate|position|advance) (?:the|a|an|our|this|that)\b"]),
    "ai_vocab": ("low", [r"\b(?:delv\w+|leverag\w+|utiliz\w+|utilis\w+|robust|comprehensive|streamlin\w+|foster\w*|facilitat\w+|pivotal|nuanced|notably|garner\w*|tapestry|landscape|intricat\w+|interplay|meticulous\w*|showcas\w+|underscor\w+|myriad|multifaceted|boasts|realm)\b"]),
    "vague_eval_adj": ("low", [r"\b(?:profound|meaningful|significant|crucial|vital|essential|fundamental|paramount|substantial|considerable|notable|central|salient|structural|primary|critical|deeper|broader|richer)\b"]),
    "hedge_phrase": ("low", [r"\b(?:it is important to note|it is worth noting|it is worth mentioning|it should be noted|in many cases|more often than not|needless to say|it goes without saying)\b"]),
    "hedge_modal": ("low", [r"\b(?:may|might|could|would)\b"]),
    "puffery": ("low", [r"\b(?:serves as a|stands as a|is a testament|plays a (?:vital|crucial|pivotal|significant|key) role|under(?:scor|lin)es (?:its|the) importance|highlights (?:its|the) importance|key turning point)\b"]),
    "disclaimer": ("low", [
        r"\bexistence proof\b|\bnot a validation\b|\bbounds (?:the|rather)\b|\bn=1\b|one system, one principal"
        r"|\b(?:we )?(?:do not|don't|cannot|can't|make no|claim no) claim\b|\bwe concede\b|\bwe acknowledge\b"
        r"|\bshort of (?:a )?(?:validation|proof|guarantee|claim)\b|\bwithout (?:establishing|claiming|proving)\b"
        r"|\b(?:an? )?(?:modest|preliminary|illustrative|tentative) (?:claim|case|step|illustration|reading)\b"
        r"|\bholding[^.,]{0,20}(?:scope|view)\b|\bis itself (?:a )?(?:limit|caveat|tell)\b"
        r"|\bconsistent with[^.,]{0,30}(?:not|rather than)\b|\bnot (?:proof|a proof|validation|evidence) of\b"
        r"|\bwe are careful\b|\bto be (?:honest|clear|fair) about\b|\billustration (?:rather than|, not|not a)\b"]),
    "coined_jargon": ("p", [r"\\(?:textbf|emph|textit)\{[A-Z][A-Za-z][^}]{2,46}\}|\*\*[A-Z][A-Za-z][^*]{2,46}\*\*|[`'\"][A-Z][a-z]+(?: [A-Z][a-z]+){1,3}[`'\"]"]),
    "placeholder": ("raw", [
        r"(?i)\b[xX]{3,}\b|\[(?:TODO|TBD|cite|citation|ref|N|x+|\.\.\.|placeholder)\]|<[a-z][a-z _/-]{2,22}>"
        r"|\bTBD\b|\bFIXME\b|\bplaceholder\b|lorem ipsum"
        r"|oaicite|contentReference|attributableIndex|turn\d+(?:search|view|news|forecast|image)\d+|:::\s*(?:writing|note|task)"]),
    "false_scale": ("pc", [r"(?i)\b(?:\d{2,}|dozens|hundreds|thousands|scores|myriad|numerous|countless)\s+(?:of\s+)?(?:tables?|figures?|experiments?|conditions?|variants?|configurations?|ablations?|baselines?|settings?|scenarios?)\b"]),
    "inline_bold_list": ("raw", [r"(?m)^[ \t>]*(?:[-*•‣]|\d+[.)])\s+\*\*[^*\n]{1,70}\*\*"]),
    "reformulation": ("low", [r"\b(?:in other words|that is to say|put (?:it )?differently|to put it another way|i\.e\.|stated differently|simply put|or rather)\b"]),
    "explicit_crossref": ("low", [r"\bas (?:discussed|noted|shown|mentioned|described|seen|explained|stated) (?:above|below|earlier|previously)\b|\bas we (?:will|shall) (?:see|show|discuss)\b|\breturning to (?:the|our|this)\b|\bas noted (?:above|earlier)\b"]),
}
#: The triadic pattern with possessive runs that start at a delimiter: the same
#: matches without quadratic backtracking in Java.
TRIADIC_ANCHORED = r"(?<![^,.;:()])[^,.;:()]++,\s+[^,.;:()]++,\s+(?:and|or)\s+[^,.;:()]+"
TRANSITION_OPEN = r"^(?:Furthermore|Moreover|Additionally|However|Therefore|Thus|Consequently|Indeed|Notably|Importantly|In addition|In conclusion|To summari[sz]e|In summary)\b"
LIST_LINE = r"^[ \t>]*(?:[-•‣*]|\d+[.)])\s"
BOLD_IN_LINE = r"(?:^|[^*])\*\*[^*\n]{1,60}\*\*"

# Default thresholds, bands, and the order of the feature row.
DEFAULTS = {
    "pct_short": 9.0, "emdash": 3.0, "semicolon": 2.5, "comma_not": 0.7, "rather_than": 1.3, "not_but": 0.8, "triadic": 11.0,
    "compound_and": 13.0, "appositive": 0.6, "what_cleft": 1.6, "abstract_subj": 1.0, "para_open_The": 7.0, "demonstr_abstract": 0.5,
    "which_is_tail": 0.9, "the_way_each": 0.3, "to_inf_purpose": 1.6, "intensifier": 1.8, "that_density": 17.0, "first_person": 99.0,
    "meta_narration": 1.2, "ai_vocab": 4.0, "vague_eval_adj": 5.0, "transition_open": 4.0, "hedge_phrase": 0.6, "hedge_modal": 99.0,
    "puffery": 0.5, "coined_jargon": 4.0, "placeholder": 0.1, "false_scale": 0.2, "inline_bold_list": 0.4, "bold_run": 0.6,
    "reformulation": 1.0, "explicit_crossref": 0.6,
}
MISSING_DEFAULT = 1.0
BANDS = {"mean_sent": (15.0, 33.0), "burstiness_CV": (0.45, 1.2)}
COUNTED = [*SHAPE, "para_open_The", "transition_open", "bold_run"]
FEATURES = ["mean_sent", "burstiness_CV", "pct_short", *COUNTED]

# Features that are glossed for readers, and those where low tells.
LOWER_IS_TELL = ["burstiness_CV", "mean_sent", "first_person"]
GLOSSED = (
    "mean_sent burstiness_CV pct_short emdash semicolon comma_not rather_than not_but triadic compound_and appositive what_cleft "
    "abstract_subj para_open_The demonstr_abstract which_is_tail the_way_each to_inf_purpose intensifier that_density first_person "
    "meta_narration ai_vocab vague_eval_adj transition_open hedge_phrase hedge_modal puffery disclaimer"
).split()

# Heading and nominalisation rules.
NOMINAL_SUFFIX = r"(?:tion|sion|ment|ance|ence|ity|ety|ism|ness|ure|acy|ship|hood|al|cy)$"
NOMINAL_STOP = (
    "the a an of to in on for and or over with as is are was were be that this these those from one its "
    "their our we who whom whose what when where why how no not"
).split()
STANDARD_HEADINGS = [
    "introduction", "conclusion", "conclusions", "abstract", "background", "discussion", "results", "method", "methods", "related work",
    "references", "acknowledgments", "acknowledgements", "limitations", "appendix", "preliminaries", "notation", "overview", "summary",
]
INTERROGATIVE = r"(?i)^(?:what|how|why|when|where|who|whom|whose|which|whether|is|are|was|were|do|does|did|can|could|should|would|will|shall|has|have|had|may|might)\b"
SELF_CONGRATULATION = r"(?i)\b(?:honest|candid|careful|rigorous|novel|elegant|crucial|just good)\b"
TITLE_CASE_EXEMPT = ["ai", "eu", "gaap", "sox", "us", "uk", "rlhf", "llm"]

# Stop words and suffixes of content stems, in their order.
STEM_STOP = (
    "the a an of to in and or for on with as is are was were be been being by that this these those it its "
    "their they them we our us you your he she his her at from into than then so but not no nor only also both each more most "
    "other some such which who whom whose what when where why how all any can could may might must shall should will would "
    "do does did done has have had having if because while between within without about over under above below up down out "
    "off again further once here there very just i me my mine yours one two three first second"
).split()
STEM_SUFFIXES = ["ization", "izing", "ized", "izes", "ness", "ing", "ed", "es", "ly", "s"]

# Discourse patterns.
PAYOFF = r"(?i)\b(?:we (?:show|find|report|demonstrate|prove)|the result\b|figure \d|table \d|our (?:main )?(?:finding|contribution|result) is|the (?:main )?(?:finding|result|upshot) is)\b"
CAVEAT = r"(?i)\b(?:caveat|limitation|does not establish|do not establish|awaits replication|cannot prove|open question|beyond (?:the )?scope|roadmap|to be clear|not (?:a )?claim|make no claim|existence proof|preliminary|illustrative|tentative|we concede|we acknowledge)\b"
CONNECTIVE = r"(?i)\b(?:therefore|however|moreover|furthermore|thus|hence|importantly|notably|crucially|consequently|in other words|that is|as such)\b"
HEDGE = r"(?i)\b(?:may|might|could|tends to|somewhat|arguably|largely|generally|in part|to some extent|relatively)\b"
EXAMPLE = r"(?i)\b(?:for example|for instance|consider|imagine|like a )\b"
SELF_SCORE = (
    r"(?i)scored the draft|\breview of this (?:paper|draft|manuscript)\b|\bself-score\b"
    r"|\b(?:scored|rated)\b[^.]{0,30}\bthis (?:paper|draft|manuscript)\b"
    r"|\bthis (?:paper|draft|manuscript)\b[^.]{0,50}\b(?:scored|rated)\b[^.]{0,15}\d+\s*/\s*100"
)
#: A contracted form needs a word character before it; taking that character
#: into the match counts the same places.
BE_VERB = [r"(?i)\b(?:is|are|was|were|be|been|being|am)\b", r"(?i)\w'(?:s|re)\b"]
NOMINALISATION = r"(?i)\b[a-z]{3,}(?:tion|sion|ment|ity|ness|ance|ence|ism|ization|isation)s?\b"
PREPOSITION = r"(?i)\b(?:of|in|on|to|for|with|by|at|from|into|over|under|through|between|among|about|against|during|without|before|after|above|below|toward|towards|upon|within|across|behind|beyond|onto|off|than|via|per)\b"
ADVERB = r"(?i)\b[a-z]{3,}ly\b"
AD_ADJECTIVE = r"(?i)\b(?:significant|substantial|considerable|various|key|crucial|novel|robust|comprehensive|important|critical|essential|fundamental|extensive|numerous|notable|prominent|vital|effective|efficient|optimal|sophisticated|rigorous|meaningful|valuable|relevant|diverse|complex|intricate|seamless|powerful|innovative|cutting-edge|state-of-the-art)\b"
WASTE = r"(?i)(?:^|[.;:,]\s+|\b(?:and|but|or|which|that|because|since|while|when|where)\s+)(?:it|this|that|there)\s+(?:is|are|was|were|will|would|can|could|may|might|has|have|had)\b"
STANCE = [
    r"(?i)\b(?:may|might|could|perhaps|possibly|relatively|somewhat|arguably|likely|presumably|suggest(?:s|ed|ing)?|appear(?:s|ed|ing)?|seem(?:s|ed|ing)?|tend(?:s|ed)? to|in part|to some extent|in some sense|more or less|fairly)\b",
    r"(?i)\b(?:clearly|obviously|undoubtedly|certainly|demonstrate(?:s|d)?|establish(?:es|ed)?|prove(?:s|d|n)?|in fact|indeed|of course|must|definitely|evidently|without doubt|it is clear|show(?:s|n)? that)\b",
    r"\b(?:I|we|our|my|us|the author(?:s)?)\b",
    r"(?i)\b(?:importantly|remarkably|surprisingly|unfortunately|crucially|notably|interestingly|strikingly|curiously|tellingly|regrettably|fortunately|admittedly)\b",
]
ENGAGEMENT = r"(?i)\b(?:consider|imagine|note that|suppose|recall|picture|let us|let's|think of|think about|take(?: the case)?|notice|observe that|you|your|we (?:can|will) see|ask yourself|remember that)\b"
IMPERATIVES = "show hand watch notice see look take start begin ask suppose consider imagine picture recall think note compare try assume observe contrast".split()
COHESION_STOP = (
    "a an the of in on to for with by at from into over under through and or but nor so yet is are was were be been being am has have had "
    "do does did will would shall should can could may might must this that these those it its they them their he she his her him we our us "
    "you your i my me as if then than not no too very just only also even still such which who whom whose what when where why how all any "
    "some each every both either neither one two more most much many few less least own same other another about above below between among "
    "during without within across"
).split()

# Section types; the first rule that matches wins.
SECTION_TYPES = {
    "academic": [
        ("intro", r"\bintroduction\b|\bmotivation\b"),
        ("related", r"related work|prior work|\bliterature\b|state of the art|\bbackground\b"),
        ("framework", r"definition|\bscope\b|preliminar|notation|framework|architecture|\bmodel\b|approach|\bdesign\b|method|theory|conceptuali"),
        ("evidence", r"result|finding|evaluation|experiment|case study|measur|\banalysis\b|empiric|\bstudy\b"),
        ("discussion", r"discussion|objection|disanalog|limitation|threat|implication|governance|recommendation|polic"),
        ("conclusion", r"conclusion|concluding|final remark|closing remark|\boutlook\b"),
        ("appendix", r"appendix|implementation mechanism|supplementary|declaration|statement"),
    ],
    "design-doc": [
        ("motivation", r"motivation|problem|\bwhy\b|non-?goals?|\bgoals?\b|objective|background|context|tl;?dr|summary|overview|where .* (?:lives|matters)"),
        ("concept", r"concept|definition|\bmodel\b|abstraction|\bidea\b|principle|approach|design|architecture|mechanism|how (?:it|this|the)|what (?:is|it)|choosing|unit of"),
        ("consequence", r"consequence|implication|\bresult|effect|what changes|what stays|impact|outcome|so what"),
        ("tradeoff", r"trade-?off|alternative|\boption|comparison|\bversus\b|\bvs\b|considered|rejected|limitation|\brisk|drawback|caveat|failure mode"),
        ("migration", r"migration|rollout|adoption|maintainer|next steps?|\bfuture\b|\bplan\b|roadmap|\btodo\b|what to do"),
        ("example", r"example|\bcase\b|scenario|walkthrough|in practice|concretely|flywheel|recipe"),
        ("meta", r"reference|appendix|glossary|see also|related|acknowledg|\bindex\b"),
    ],
    "essay": [
        ("hook", r"tl;?dr|\bintro|motivation|the problem|puzzle|\bwhy\b|setup|premise|starting point|the question"),
        ("thesis", r"thesis|claim|the (?:idea|point|argument)|position|in short|the core|what i(?:'?m| am) arguing"),
        ("development", r"because|mechanism|how (?:it|this|the)|in detail|unpack|the case for|reasoning|derivation"),
        ("example", r"example|\bcase\b|concretely|in practice|illustration|story|scenario|consider|suppose|imagine"),
        ("objection", r"objection|\bbut\b|counter|worry|pushback|response|rebuttal|caveat|to be fair|one might"),
        ("implication", r"implication|upshot|so what|consequence|takeaway|why it matters|what this means|\bmoral\b"),
        ("close", r"conclu|closing|\bcoda\b|where this leaves|in sum|wrapping up|\bfinal"),
    ],
}
CONCLUSION_TITLE = r"(?i)^\s*(?:\d+(?:\.\d+)*\.?\s*)?(?:conclusion|conclusions|concluding\s+remarks|discussion\s+and\s+conclusion|final\s+remarks?|closing\s+remarks?|outlook)\b"

# Citation rules.
AUTHORS = r"[A-Z][\p{L}\p{N}_'’.-]+(?:\s+(?:and|&)\s+[A-Z][\p{L}\p{N}_'’.-]+|\s+et\s+al\.?|\s+and\s+colleagues)?"
YEAR = r"(?:19|20)\d\d"
OVERCLAIM = r"(?:predicts?|shows?|proves?|demonstrat\w+|casts?|frames?|classif\w+|finds?|establish\w+|argues?|derives?|coin\w+|introduc\w+|defin\w+|reveals?)"
NOT_SURNAMES = ["the", "section", "table", "figure", "appendix", "enron", "sarbanes", "oxley"]

# Syntax word lists.
DISCOURSE_NOUNS = (
    "paper argument section claim contribution model analysis point framework thesis reading account table chapter essay study work "
    "discussion approach aim purpose parallel analogy homology prediction proposition lesson upshot crux ledger"
).split()
STANCE_VERBS = "concede grant acknowledge decline disclaim qualify hedge stress emphasize emphasise name note hold bury admit caution disavow own".split()
STATUS_ADJECTIVES = "modest honest careful candid partial incomplete limited deliberate explicit tentative provisional narrow thin precise cautious conscious removable".split()
PREDICATE_NOUNS = "contribution point crux claim thesis lesson upshot aim purpose move".split()
CLAIM_VERBS = "claim prove derive establish assert guarantee".split()
CLAUSE_DEPS = ["advcl", "ccomp", "relcl", "acl", "csubj"]
NOUN_SUFFIX = r"(?:tion|ment|ence|ance|ity|ness|ism|sion)$"

# The corpus-diction stop list and the texture features watched.
DICTION_STOP = (
    "which their there about would these other where while have been that this from with into more than then them such your only over most "
    "some what when also between because through against during before after under above being"
).split()
TEXTURE = "emdash intensifier ai_vocab vague_eval_adj puffery meta_narration transition_open hedge_phrase not_but comma_not".split()

# Categories as id, family, label, features that cover them.
TAXONOMY = [
    ("meta_narration", "discourse-stance", "Meta-narration (body + heading level)", "meta_narration metanarr_synt compound mean_words"),
    ("hedging_miscalibration", "discourse-stance", "Hedging miscalibration (lockstep + over-honesty)", "hedge_modal disclaimer hedge_phrase"),
    ("antithesis", "rhythm", "Antithetical parallelism (not-X-but-Y + AABB)", "comma_not rather_than not_but"),
    ("over_triadic", "syntactic-shape", "Over-triadic structure", "triadic"),
    ("abstract_subject", "syntactic-shape", "Abstract-subject / nominalization", "abstract_subj nominal_rate para_open_The"),
    ("importance_inflation", "lexical", "Importance inflation (adjective + phrase + trailing clause)", "vague_eval_adj adj_rate puffery"),
    ("appositive_restate", "syntactic-shape", "Comma-appositive restatement", "appositive"),
    ("cleft", "syntactic-shape", "It-/what-cleft fronting", "what_cleft"),
    ("elegant_variation", "lexical", "Elegant variation", ""),
    ("template_repetition", "syntactic-shape", "Template repetition", ""),
    ("transition_signpost", "lexical", "Transition over-signposting", "transition_open"),
    ("generic_ai_vocab", "lexical", "Generic-AI vocabulary", "ai_vocab"),
    ("hollow_hedge", "lexical", "Hollow hedge phrase", "hedge_phrase"),
    ("frictionless_balance", "semantic", "Frictionless balance / no risk", ""),
    ("false_range", "semantic", "False range / false precision", ""),
    ("uniform_rhythm", "rhythm", "Uniform sentence rhythm", "burstiness_CV mean_sent"),
    ("titlecase_headings", "headings", "Title-Case headings", "title_case"),
    ("nominalization_headings", "headings", "Vague abstract-nominalization headings", "nominalization"),
    ("clever_headings", "headings", "Clever / quoted / self-referential headings", "quoted antithesis selfcong"),
    ("coined_jargon", "lexical", "Coined / unsignaled neologisms", "coined_jargon"),
    ("template_placeholder", "structure", "Placeholder / template residue", "placeholder"),
    ("false_scale", "semantic", "False-scale / over-enumeration", "false_scale"),
    ("listification", "structure", "Listification / inline-header lists", "inline_bold_list"),
    ("bold_overuse", "structure", "Boldface overuse", "bold_run"),
    ("emdash_punct", "punctuation", "Em-dash / punctuation overuse", "emdash"),
    ("weasel_attribution", "discourse-stance", "Weasel-word attribution", ""),
    ("this_fronting", "syntactic-shape", "Demonstrative 'This/These' fronting", ""),
    ("reformulation_overuse", "discourse-stance", "Reformulation-marker overuse", "reformulation"),
    ("explicit_crossref", "lexical", "Explicit cross-reference over-signaling", "explicit_crossref"),
    ("conclusion_summary", "discourse-stance", "Conclusion opened as structure-summary", ""),
]

#: What each category is, and what a judge is asked about it.
PROBES = {
    "meta_narration": ("Sentences about the text's own moves instead of its subject", "Where does the text announce, defend or sum up its own steps rather than make them"),
    "hedging_miscalibration": ("Caution spread evenly over strong and weak claims alike", "Where is a plain claim hedged, or a limit confessed that nobody would doubt"),
    "antithesis": ("Points made by first denying something else", "Where does a sentence say what a thing is not only to say what it is"),
    "over_triadic": ("Lists that keep coming in threes", "Where do items come in threes although two or four would be truer"),
    "abstract_subject": ("Abstract nouns act where people or things could", "Where is an abstraction the subject of a verb that somebody performs"),
    "importance_inflation": ("Praise of a matter's weight in place of evidence for it", "Where is something called important without a reason in sight"),
    "appositive_restate": ("A noun restated at once between commas", "Where does a phrase between commas only say its noun again"),
    "cleft": ("Clauses split for emphasis", "Where would a plain clause do for a what-is or it-is construction"),
    "elegant_variation": ("One thing under changing names", "Where does one thing get a new name for variety alone"),
    "template_repetition": ("Paragraphs or sentences built on one mould", "Where do neighbouring sentences or paragraphs repeat one frame"),
    "transition_signpost": ("Openers that mark every turn", "Where does a sentence open with a connective that the order already gives"),
    "generic_ai_vocab": ("Stock vocabulary of generated prose", "Where is a stock word used for a plainer one"),
    "hollow_hedge": ("Set phrases of caution that limit nothing", "Where could a phrase of caution go without any change in meaning"),
    "frictionless_balance": ("Both sides weighed, nothing decided", "Where are costs and gains set side by side without a choice being risked"),
    "false_range": ("Ranges and figures more exact than their basis", "Where does a from-to or a number pretend to a scale that isn't there"),
    "uniform_rhythm": ("Sentences of one length", "Where do sentences follow one another at the same length"),
    "titlecase_headings": ("Headings with every word capitalised", "Which headings capitalise words that the text would not"),
    "nominalization_headings": ("Headings of abstract nouns", "Which headings name an abstraction instead of what happens"),
    "clever_headings": ("Headings that pose", "Which headings quote, pun or praise instead of naming their matter"),
    "coined_jargon": ("Terms made up and never explained", "Which terms are new here and used as if they were known"),
    "template_placeholder": ("Residue of a form or tool", "Where did a placeholder or a tool's mark stay in the text"),
    "false_scale": ("Counts that make a small thing look large", "Where is an amount of apparatus listed to impress"),
    "listification": ("Prose cut into lists with bold heads", "Where would running sentences do for a list of labelled items"),
    "bold_overuse": ("Bold type all through the prose", "Where is a word bold although nothing hangs on it"),
    "emdash_punct": ("Dashes where commas or stops would do", "Where does a dash join what a comma or a full stop would"),
    "weasel_attribution": ("Claims laid to nobody in particular", "Where is a claim given to experts, critics or many without a name"),
    "this_fronting": ("Sentences opened by this or these with a summary noun", "Where does a sentence open by pointing back at a whole passage"),
    "reformulation_overuse": ("The same said again in other words", "Where does a marker such as in other words bring nothing new"),
    "explicit_crossref": ("Readers sent about the text", "Where is a reader told where to look although it is plain"),
    "conclusion_summary": ("An ending that tells the structure again", "Where does the ending list what each part did"),
}

# Categories that mark each register.
REGISTERS = {
    "naive-generation": "importance_inflation generic_ai_vocab over_triadic abstract_subject transition_signpost antithesis uniform_rhythm hollow_hedge this_fronting listification bold_overuse emdash_punct weasel_attribution reformulation_overuse explicit_crossref",
    "deliberative-revision": "meta_narration hedging_miscalibration frictionless_balance appositive_restate cleft false_range elegant_variation template_repetition conclusion_summary",
}

# Marks of genres.
ACADEMIC_MARK = r"(?im)\\section|\\cite|^#+\s*(?:abstract|related work)\b|\bliterature review\b"
ACADEMIC_ANY = r"(?im)\\section|\\cite|^#+\s*abstract\b|related work"
ESSAY_NOT = r"(?i)\\section|\\cite|#+\s*abstract\b|related work|```bash|pip install|npm install|## (?:installation|usage|getting started)|make hello"
ARGUING = r"(?i)\b(?:because|therefore|however|suppose|consider|imagine|i think|i argue|we argue|the point is)\b"
SPEAKING = r"(?i)\b(?:i|we|you|my|our)\b"
README = r"(?i)pip install|npm install|git clone|##\s*(?:installation|usage|getting started|quick\s*start)"
VOICE = r"\b(?:i|we|you|my|our)\b"
ARGUMENT = r"\b(?:because|therefore|however|suppose|consider|imagine|i argue|i think|the point is)\b"
