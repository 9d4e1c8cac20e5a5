"""Schemas of the stored tables and of the feed payloads, as Spark DDL."""

from __future__ import annotations

QUOTES = (
    "bookmaker string, tournament string, betRadarID bigint, event string, "
    "date timestamp_ntz, bet string, betOdd decimal(10,2), ingest_seq bigint"
)

MATCHES2 = (
    "RTP decimal(10,2), tournament string, betRadarID bigint, event string, "
    "date timestamp_ntz, bookmaker1 string, bet1 string, betOdd1 decimal(10,2), "
    "bookmaker2 string, bet2 string, betOdd2 decimal(10,2), insertingdate timestamp_ntz"
)

MATCHES3 = (
    "RTP decimal(10,2), tournament string, betRadarID bigint, event string, "
    "date timestamp_ntz, bookmaker1 string, bet1 string, betOdd1 decimal(10,2), "
    "bookmaker2 string, bet2 string, betOdd2 decimal(10,2), "
    "bookmaker3 string, bet3 string, betOdd3 decimal(10,2), insertingdate timestamp_ntz"
)

# Odds pages. Prices and shared ids are read as text, so that both 1.85 and
# "1.85" survive.
FLAT_PAGE = (
    "struct<events:array<struct<Id:bigint,BetRadarId:string,Name:string,StartDate:string>>,"
    "eventsOutcome:array<struct<EventId:bigint,Kind:struct<Name:string>,Name:string,Odds:string>>>"
)

NESTED_PAGE = (
    "struct<head:map<string,struct<name:string,"
    "spreadOptions:map<string,struct<key:string,display:string>>>>,"
    "body:map<string,struct<name:string,dateTimeUTC:string,"
    "externalReferences:struct<BetRadar:struct<matchId:string>>,"
    "bets:map<string,struct<hasSpread:boolean,additionalInfos:map<string,struct<status:int,"
    "outcome:map<string,struct<status:int,label:string,val:string>>>>>>>>>"
)

OFFER_PAGE = (
    "struct<events:array<struct<`group`:string,start:string,name:string>>,"
    "betOffers:array<struct<criterion:struct<label:string>,"
    "outcomes:array<struct<line:double,label:string,oddsFractional:string>>>>>"
)

MAP_PAGE = (
    "struct<avvenimentoFeList:array<struct<data:string,codiceAvvenimento:bigint,"
    "descrizione:string,externalProviderInfoList:array<struct<idAvvProviderLive:string>>>>,"
    "infoAggiuntivaMap:map<string,struct<codiceAvvenimento:bigint,descrizione:string,"
    "esitoList:array<struct<descrizione:string,quota:bigint>>>>>"
)

# Schedule pages: the tree of tournaments.
FLAT_SCHEDULE = (
    "array<struct<Children:array<struct<Children:array<struct<Id:bigint,Name:string>>>>>>"
)

NESTED_SCHEDULE = (
    "struct<sports:map<string,struct<categories:map<string,struct<tournaments:map<string,"
    "struct<sportCode:string,id:bigint,name:string,betCode:string,betSection:string,"
    "eventsCounter:map<string,bigint>>>>>>>>"
)

OFFER_SCHEDULE = (
    "struct<`group`:struct<groups:array<struct<groups:array<struct<termKey:string,"
    "eventCount:bigint,groups:array<struct<termKey:string,eventCount:bigint>>>>>>>>"
)

MAP_SCHEDULE = (
    "struct<manifestazioneListByDisciplinaTutti:map<string,array<string>>,"
    "manifestazioneMap:map<string,struct<topManifestazione:boolean,descrizione:string>>,"
    "eventsNumberByManifestazioneTutti:map<string,bigint>>"
)

# Tournament pages: the events of one tournament.
NESTED_EVENT_LIST = "struct<body:map<string,struct<liveStatus:string>>>"
OFFER_EVENT_LIST = "struct<events:array<struct<event:struct<id:bigint>>>>"
