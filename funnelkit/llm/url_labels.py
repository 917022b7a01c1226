"""The small table of labelled urls that the url filter is trained from."""

#: Urls to block (advertising, gambling, adult, pharmacy spam, malware, link farms, trackers).  Made up; reserved names only.
BLOCK = """
http://free-casino.example/bonus
http://lucky-casino-slots.example/play/now
https://online-casino.test/slots/jackpot
https://bets-online.example/odds/live
http://free-bets.test/bonus/signup
https://sportsbets.example/odds
http://poker-win.test/jackpot/play
https://poker-bonus.example/free/chips
http://slots-jackpot.example/win
https://win-big-slots.test/free/spins
http://free-spins.example/casino/bonus
https://viagra-cheap.example/buy
http://cheap-pills.test/viagra/order
https://pills-online.example/buy/cheap
http://cheap-pharmacy.example/pills/buy
https://buy-pills-now.test/order/cheap
http://xxx-cams.example/live
https://adult-cams.test/xxx/free
http://hot-xxx-video.example/adult
https://free-porn.test/video/hot
http://porn-tube.example/xxx
https://adult-dating.example/hot/singles
http://hot-singles.test/dating/adult
https://ads.tracker.example/click?id=1
http://adserver.test/banner/click
https://banner-ads.example/popup
http://popup-ads.test/click/banner
https://click.adnetwork.example/redirect
http://track.adserver.example/pixel.gif
https://pixel-tracker.test/track/click
http://tracker-pixel.example/redirect/ads
https://doubleads.example/popup/banner
http://free-download-crack.example/keygen
https://crack-keygen.test/warez/download
http://warez-serials.example/crack
https://keygen-warez.test/crack/free
http://free-ringtones.example/download/win
https://win-free-phone.test/prize/claim
http://claim-prize.example/winner/free
https://prize-winner.test/claim/now
http://secure-login-verify.example/account/update
https://verify-account.test/login/confirm
http://account-update-login.example/verify
https://login-confirm.test/secure/verify
http://cheap-loans.example/payday/apply
https://payday-loans.test/cash/fast
http://fast-cash-loans.example/payday
https://cheap-watches.test/replica/buy
http://replica-watches.example/cheap/rolex
https://replica-bags.test/buy/cheap
http://buy-cheap-followers.example/likes
https://cheap-followers.test/buy/likes
http://seo-links.example/buy/backlinks
https://backlinks-cheap.test/seo/links
http://work-from-home-cash.example/earn/fast
https://earn-fast-cash.test/free/money
http://free-money.example/earn/cash
https://crypto-doubler.test/bonus/earn
http://forex-bonus.example/earn/win
https://miracle-diet-pills.example/buy/now
""".split()

#: Urls to allow (news, reference, schools, public bodies, personal pages, shops, forums).  Made up; reserved names only.
ALLOW = """
http://daily-news.example/world/2021/article.html
https://news.city.example/politics/story-17.html
https://www.morning-paper.test/culture/review
http://www.evening-post.example/science/article/88
https://library.example/catalogue/books/history
http://www.city-library.test/books/new
https://encyclopedia.example/wiki/River
http://wiki.test/page/Mathematics
https://www.university.example/research/physics
http://physics.university.test/people/staff
https://school.example/timetable/2022
http://www.primary-school.test/parents/news
https://museum.example/exhibitions/painting
http://www.art-museum.test/collection/19th-century
https://health.ministry.example/guidelines/vaccines
http://www.ministry.test/law/documents/101
https://court.example/decisions/2020/55
http://weather.example/forecast/weekly
https://www.weather-service.test/maps/rain
http://recipes.example/soup/tomato
https://cooking.test/recipes/bread.html
http://garden.example/plants/roses
https://www.garden-club.test/notes/spring
http://blog.example/2019/05/travel-notes
https://m.blog.test/posts/4411
http://blog.mountain.example/hiking/trails
https://travel.example/guides/italy
http://www.rail.test/timetables/stations
https://docs.example/manual/install.html
http://docs.library.test/reference/api/strings
https://developer.example/tutorials/python
http://forum.example/threads/3021
https://forum.linux.test/topic/kernel
http://mail.example/help/settings
https://shop.example/books/novels/77
http://www.bookstore.test/fiction/authors
https://furniture.example/tables/oak
http://bicycle.test/repair/chain
https://music.example/concerts/season
http://www.orchestra.test/programme/2023
https://film.example/reviews/drama
http://theatre.test/plays/autumn
https://football.example/league/results
http://www.chess.test/games/openings
https://biology.example/species/birds
http://astronomy.test/planets/mars.html
https://chemistry.example/elements/iron
http://history.test/europe/middle-ages
https://dictionary.example/word/river
http://grammar.test/lessons/verbs
https://maps.example/city/streets
http://www.parish.test/church/music
https://jobs.example/engineers/listing
http://www.company.test/about/contact.html
https://bank.example/branches/opening-hours
http://insurance.test/home/terms
https://archive.example/letters/1890
http://www.archive.test/photographs/harbour
https://statistics.example/population/tables
http://census.test/data/households.csv
""".split()

LABELLED = [(url, 1) for url in BLOCK] + [(url, 0) for url in ALLOW]
