"""Fixed values of the rule language: names, aliases and vocabularies that results must agree on."""

from __future__ import annotations

#: Aliases of redirect resources and the names that they stand for (fixed values).
RESOURCE_ALIASES: dict[str, str] = {
    "1x1-transparent.gif": "1x1.gif",
    "2x2-transparent.png": "2x2.png",
    "3x2-transparent.png": "3x2.png",
    "32x32-transparent.png": "32x32.png",
    "noopjs": "noop.js",
    "blank-js": "noop.js",
    "nooptext": "noop.txt",
    "noopframe": "noop.html",
    "noopjson": "noop.json",
    "noopmp4-1s": "noop-1s.mp4",
    "blank-mp4": "noop-1s.mp4",
    "noopmp4-2s": "noop-2s.mp4",
    "noopmp4-3s": "noop-3s.mp4",
    "noopmp3-0.1s": "noop-0.1s.mp3",
    "blank-mp3": "noop-0.1s.mp3",
    "noopmp3-0.5s": "noop-0.5s.mp3",
    "noopvast-2.0": "noop-vast2.xml",
    "noopvast-3.0": "noop-vast3.xml",
    "noopvast-4.0": "noop-vast4.xml",
    "noopvmap-1.0": "noop-vmap1.xml",
    "noop-vmap1.0.xml": "noop-vmap1.xml",
    "amazon-adsystem.com/aax2/amzn_ads.js": "amazon_ads.js",
    "ampproject.org/v0.js": "ampproject_v0.js",
    "doubleclick.net/instream/ad_status.js": "doubleclick_instream_ad_status.js",
    "google-analytics.com/cx/api.js": "google-analytics_cx_api.js",
    "google-analytics.com/ga.js": "google-analytics_ga.js",
    "google-analytics.com/inpage_linkid.js": "google-analytics_inpage_linkid.js",
    "static.chartbeat.com/chartbeat.js": "chartbeat.js",
    "google-ima3": "google-ima.js",
    "widgets.outbrain.com/outbrain.js": "outbrain-widget.js",
    "popads.net.js": "popads.js",
    "prevent-popads-net.js": "popads.js",
    "scorecardresearch.com/beacon.js": "scorecardresearch_beacon.js",
}

#: Resources that a redirect may name by default (fixed values).
REDIRECT_ALLOWLIST = (
    "1x1.gif", "2x2.png", "3x2.png", "32x32.png", "empty", "noop.js", "noop.txt", "noop.html", "noop.css", "noop.json",
    "noop-1s.mp4", "noop-2s.mp4", "noop-3s.mp4", "noop-0.1s.mp3", "noop-0.5s.mp3", "noop-vast2.xml", "noop-vast3.xml",
    "noop-vast4.xml", "noop-vmap1.xml", "google-analytics_analytics.js", "googletagmanager_gtm.js",
    "googlesyndication_adsbygoogle.js", "googletagservices_gpt.js", "google-ima.js", "amazon_ads.js",
)

#: Hosts-file names of the local machine, which make no rule (fixed values).
LOCAL_NAMES = ("localhost", "ip6-localhost", "ip6-loopback", "ip6-localnet", "ip6-mcastprefix", "ip6-allnodes", "ip6-allrouters", "ip6-allhosts", "broadcasthost", "local")

#: Content-type options (fixed values).
CONTENT_TYPES = ("script", "image", "stylesheet", "object", "object-subrequest", "media", "subdocument", "document", "ping", "xmlhttprequest", "xhr", "websocket", "font", "other", "popup")

#: Options that only narrow a rule, so that the option-less twin covers it (fixed values).
NARROWING = ("script", "image", "stylesheet", "object", "object-subrequest", "media", "subdocument", "ping", "xmlhttprequest", "xhr", "websocket", "font", "other", "popup", "http", "https", "third-party", "first-party")

#: Options of our grammar beside content types: flags, and those that take a value.
FLAGS = ("all", "http", "https", "third-party", "first-party", "3p", "1p", "important", "match-case", "badfilter", "generichide")
VALUED = ("domain", "from", "redirect", "redirect-rule", "rewrite", "csp", "removeparam")
REDIRECTS = ("redirect", "redirect-rule", "rewrite")

#: Procedural operators that run, and those that no engine here can run (fixed values).
RUNNABLE = (":has-text(", ":matches-css(", ":matches-attr(", ":matches-path(", ":min-text-length(", ":upward(", ":xpath(", ":style(", ":remove(", ":remove-attr(", ":remove-class(")
DEAD = (":others(", ":matches-media(", ":-abp-properties(", ":matches-prop(")
#: Operators with another name for the same thing (fixed values).
RENAMED = {":contains(": ":has-text(", ":-abp-contains(": ":has-text(", ":nth-ancestor(": ":upward("}
#: Actions without an argument, which do nothing (fixed values).
EMPTY_ACTIONS = (":remove-attr()", ":remove-class()", ":style()")

#: A small table of public suffixes; pass a full one where it is at hand.
PUBLIC_SUFFIXES = ("com", "net", "org", "pl", "com.pl", "uk", "co.uk", "io", "fr", "de", "es")
